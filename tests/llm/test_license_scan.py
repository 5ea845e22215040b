import random

from gleanery.llm import license_scan as L

#: Notices worded otherwise than any in training or calibration.
UNSEEN = {
    "agpl": ("Server code: AGPLv3", "We license the server under the GNU Affero General Public License v3.0", "The daemon is AGPL software."),
    "apache-2.0": ("Code and docs are provided under the Apache License 2.0", "Apache-2.0", "The module is licensed under Apache 2.0 as of 2019", "this repository uses the Apache License,\nVersion 2.0", "Contributions are accepted under the Apache License v2.0 only"),
    "bsd": ("BSD-2", "Our code uses the 3-clause BSD license", "License :: OSI Approved :: BSD License", "Governed by a BSD license", "Redistributions of source code must keep the above copyright notice, this list of conditions and the following disclaimer."),
    "cc-by": ("Images are CC BY 4.0", "The dataset is shared under a Creative Commons Attribution 4.0 licence", "Text under CC-BY 3.0", "This book can be reused under CC BY 4.0"),
    "cc-by-nc": ("The photos are shared as CC BY-NC 4.0", "Non-commercial use only, under Creative Commons Attribution-NonCommercial 4.0", "Slides: CC-BY-NC"),
    "cc-by-sa": ("Licensed under creative commons by-sa 3.0", "Text under CC-BY-SA 4.0.", "Wiki content is shared under Creative Commons Attribution-ShareAlike", "Maps (CC BY-SA 4.0) by the community"),
    "cc0": ("The data is in the public domain (CC0 1.0)", "Metadata: CC0", "We waive our rights with CC0 1.0 Universal"),
    "gpl": ("Distributed under the terms of the GPLv2", "GNU GPL version 2 or later", "This tool is GPLv3 software", "The program is free, licensed under the GNU General Public License v3 or any later version", "License : GPL-2.0+", "The kernel module is covered by the GNU GPL"),
    "isc": ("Licensed ISC", "This package is published under the ISC license", "ISC licensed, see the top of the file"),
    "lgpl": ("The library is under the LGPL, version 2.1 or newer", "Use it under the GNU Lesser General Public License v3", "LGPLv3", "You can link to it under the LGPL"),
    "mit": ("You may use this library according to the MIT license.", "(c) 2021 Jane Doe, MIT License", "Everything in here is MIT-licensed", "License: MIT", "This project is MIT licensed.", "Forked from a tool under the MIT License", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software to deal in the Software"),
    "mpl": ("Files are subject to the Mozilla Public License 2.0", "MPL-2.0", "This add-on is under MPL 2.0", "The extension uses the Mozilla Public License"),
    "proprietary": ("Copyright (c) 2012 Foo Ltd, all rights reserved", "Strictly confidential and proprietary", "No part of this book may be reproduced without written permission from the publisher", "All Rights Reserved by the band"),
    "unlicense": ("Released into the public domain under the Unlicense", "This is free and unencumbered software", "The scripts are free and unencumbered software in the public domain"),
}
#: Sentences that use licence words and license nothing, unlike those in training or calibration.
PLAIN = (
    "The senator's license to speak was revoked.", "MIT researchers published version 2.0 of the study.", "She works for the Apache foundation in Berlin.",
    "The general public license fee is paid by all households.", "He copied the file under the terms of the deal.", "Copyright is a right.", "The permission notice on the door was torn.",
    "The creative director attributed it to the commons.", "mit dem Zug nach Berlin", "Il est mit en prison", "The source code of the program may be obtained from the author.",
    "All rights were waived by the owner.", "The GNU project began in 1983.", "Her hunting licence was granted in 2.1 days.", "Distribution of water is free of charge in the town.",
    "The mozilla mascot is a dragon.", "We met at the public library, version 3 of the plan in hand.", "The lesser known general retired.", "Any person may enter without restriction.",
    "The software was modified by students.", "An agreement under the terms of the peace was signed.", "He has a licence to kill.", "Attribution errors are common.", "bsd", "The Apache tribe", "a GNU",
)


def settled(text):
    """(families, found paragraphs) with every paragraph classified in plain Python."""
    model = L.trained_model()
    families, found = set(), 0
    for part in L.split_paragraphs(text):
        p = model.probabilities(part)
        family = model.families[int(p.argmax())]
        if family != L.UNKNOWN and p.max() >= model.least:
            found += 1
            families |= {family} if L.likeness(part, family) >= L.CONFIRM else set()
    return ",".join(sorted(families)), found


def test_unseen_notices():
    got = [(f, settled(t)[0]) for f, texts in UNSEEN.items() for t in texts]
    assert len(got) > 50 and sum(f == g for f, g in got) >= 0.9 * len(got)
    assert not [g for f, g in got if g and f not in g.split(",")]


def test_plain_sentences():
    assert sum(bool(settled(t)[0]) for t in PLAIN) <= 1


def test_held_out_rows_are_unseen():
    seen = {*L.FRAMES, *L.OTHER, *(t for ts in L.NOTICES.values() for t in ts)}
    held = {*L.HELD_FRAMES, *L.HELD_OTHER, *(t for ts in L.HELD_NOTICES.values() for t in ts)}
    assert not seen & held
    assert not [t for t in L.HELD_OTHER if settled(t)[0]]
    # An empty paragraph is unknown, so paragraphs without any known gram may be passed over.
    model = L.trained_model()
    p = model.probabilities("")
    assert model.families[int(p.argmax())] == L.UNKNOWN and p[:-1].max() < model.least


def test_report(spark, docs, none, rows):
    more = spark.createDataFrame(
        [
            (100, "prose\n\nReleased under the MIT License.\nHis license plate was stolen."), (101, "Licensed under CC BY-NC 4.0."), (102, None),
            (103, "Licensed under the Apache\n * License, Version\n * 2.0 (the License); you may not use this\n * file\n\nnext"), (104, "a " * 300_000 + "\nGPLv2\n" + "of the " * 300_000),
        ],
        "doc_id bigint, text string",
    )
    got = {r["doc_id"]: r for r in L.license_report(more).collect()}
    assert (got[100]["families"], got[100]["n_paragraphs"], got[100]["n_licensed"]) == ("mit", 3, 1)
    assert got[101]["families"] == "cc-by-nc" and got[103]["families"] == "apache-2.0"
    assert got[102]["n_found"] == 0 and got[102]["families"] == "" and got[104]["n_paragraphs"] == 1
    assert L.license_report(docs).count() == len(rows)
    assert L.license_report(none).count() == 0


def test_scores_match_the_model(spark):
    texts = [n for ns in L.NOTICES.values() for n in ns] + [t for ts in UNSEEN.values() for t in ts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = L.trained_model()
    for r in L.paragraphs(docs).collect():
        parts = L.split_paragraphs(texts[r["doc_id"]])
        assert r["n_paragraphs"] == len(parts)
        for f in r["found"]:
            part = parts[f["paragraph"]]
            assert abs(f["probability"] - model.probabilities(part).max()) < 1e-3 and abs(f["similarity"] - L.likeness(part, f["family"])) < 1e-3


def test_every_paragraph_is_classified(spark):
    rng = random.Random(5)
    notices = [t for ts in L.NOTICES.values() for t in ts] + [n for ns in L.NAMES.values() for n in ns]
    texts = ["CC-BY4.0 2.0cc by", "a.\nb!\n\n\nc?) \t\nd\n--\ne", "\n", "x\n\u00e9\nGPL"]
    for t in notices * 2:
        words = t.split()
        a = rng.randrange(len(words))
        texts.append(rng.choice(["", "v2.0", "(", "see\n"]) + rng.choice([" ", "-", "  ", "/", "\n", ".\n"]).join(words[a : a + rng.randrange(1, 12)]) + rng.choice(["", ".", "2", "\n"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["families"], r["n_found"]) for r in L.license_report(docs).collect()}
    assert got == {i: settled(t) for i, t in enumerate(texts)}


def test_plan_has_no_python(spark, docs):
    plan = L.license_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Join"))
