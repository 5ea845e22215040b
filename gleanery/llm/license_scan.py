r"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a run of lines: it ends at a line that ends a sentence (``.``, ``!`` or ``?``,
perhaps before closing quotes or brackets) and before a line without letters or digits, so a
notice that is wrapped over lines is one paragraph and a short tag between blank lines is too.

Every paragraph is classified by multinomial logistic regression over the distinct word 1-
and 2-grams it holds: one class per licence family and one for unknown. Weights are trained
here, with an L1 penalty that keeps them sparse, on the families' notices, on their names set
into frames (``Licensed under the ...``), and on sentences that use the same words without
licensing anything. Words and 2-grams without a weight add nothing, so a paragraph that holds
none of the vocabulary has the scores of an empty one, which is unknown.

A prediction is confirmed if its paragraph shares at least ``CONFIRM`` of the 2-grams of one of
the family's templates (notices, and names in frames), or of its own if it has fewer. Scores are
divided by a temperature, and a family counts only from the probability at which every unknown
paragraph of the calibration set is turned down, by the model or by the templates. That set is
made of whole notices, frames and sentences that training never sees.

Training happens at the driver on the tables in this file (some thousand short rows, whatever
the corpus). Scanning is SQL functions only: no shuffle, no Python on the executors.

Defined results: null text is empty and has no licence; every document gives one row; texts
are read whole, however long; ties between families go to the first in order; repeated rows
are treated alike; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import columns_of

#: What the licences of each family are called.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0", "AGPL version 3", "AGPL-3.0-or-later", "Affero GPL"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache-2.0", "Apache 2.0", "Apache 2.0 license", "Apache License", "Apache Software License 2.0", "ASL 2.0", "Apache 2"),
    "bsd": ("BSD License", "3-Clause BSD License", "2-Clause BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "BSD-3", "BSD-2", "BSD-style license", "BSD", "modified BSD license"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0", "CC-BY", "CC-BY-4.0", "Creative Commons BY 4.0", "Creative Commons Attribution"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 3.0 Unported License", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC", "CC-BY-NC-4.0", "Creative Commons BY-NC 4.0", "Creative Commons Attribution-NonCommercial", "CC BY-NC-SA 4.0"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA", "CC-BY-SA-4.0", "Creative Commons BY-SA 3.0", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-Share Alike 3.0"),
    "cc0": ("CC0 1.0 Universal", "CC0 1.0", "CC0", "CC0-1.0", "Creative Commons Zero", "Creative Commons CC0", "CC0 1.0 Public Domain Dedication"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL", "GNU GPL version 2 or later", "GNU GPL version 3", "GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "GPL version 2", "GPL v3", "GPLv2+", "GNU Public License"),
    "isc": ("ISC License", "ISC", "ISC-style license"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License version 3", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later", "LGPL version 2.1", "Lesser GPL"),
    "mit": ("MIT License", "MIT", "MIT/X11 License", "MIT-style license", "Expat License", "MIT licence"),
    "mpl": ("Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License 1.1", "MPL 2.0", "MPL-2.0", "MPL", "MPL 1.1"),
    "unlicense": ("Unlicense", "Unlicense License"),
}
#: Sentences that a name makes a notice of: for training, then for calibration only.
FRAMES = (
    "Licensed under the {}.", "Licensed under {}", "Released under the {}.", "Released under {} terms", "This work is licensed under the {}.", "Distributed under the terms of the {}.",
    "License: {}", "SPDX-License-Identifier: {}", "This project is {} licensed.", "This software is available under the {}.", "The code is covered by the {}.", "under the {}", "{}",
    "This file is part of a library that is licensed to you under the {}.", "It is free software under the terms of the {}.", "Published under the {}", "{} licensed", "licensed {}", "see LICENSE file ({})",
)
HELD_FRAMES = ("Made available under the {}.", "Licence: {}", "This package may be used under the {}, see COPYING", "All examples are {} licensed", "Subject to the terms of the {}.", "The sources are offered under {}.")
#: Notices that don't come from a name.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "cc-by": ("To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/", "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution and reproduction in any medium, provided the original work is properly cited."),
    "cc-by-nc": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/", "You may not use the material for commercial purposes under this Creative Commons Attribution-NonCommercial license."),
    "cc-by-sa": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights under CC0"),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "lgpl": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "proprietary": (
        "All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "(c) 2015 by the publisher, all rights reserved worldwide",
        "This document is proprietary and confidential; no part of it may be reproduced without written permission.", "Proprietary and confidential. Do not distribute.",
        "No part of this publication may be reproduced, stored in a retrieval system or transmitted in any form without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.", "This software is the proprietary information of the company and may not be disclosed.", "Strictly confidential.", "may be reproduced without written permission",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "For more information, please refer to the Unlicense at http://unlicense.org/"),
}
#: Whole notices kept for calibration.
HELD_NOTICES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("The ASF licenses this file to you under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with it.",),
    "bsd": ("Redistribution and use in source and binary forms are permitted provided that the above copyright notice and this paragraph are duplicated in all such forms.",),
    "gpl": ("This is free software; you may redistribute copies of it under the terms of the GNU General Public License, with no warranty to the extent permitted by law.",),
    "lgpl": ("This library is free software; you can redistribute it under the GNU Lesser General Public License, either version 2.1 or later.",),
    "mit": ("Permission is granted, free of charge, to any person to deal in the software without restriction, provided that the permission notice is included in all copies.",),
    "proprietary": ("Copyright 1999 Acme Inc. All rights reserved. Reproduction without written permission is prohibited.", "Confidential and proprietary information of the company."),
    "unlicense": ("This software is free and unencumbered and has been released into the public domain by its author.",),
}
UNKNOWN = "unknown"
#: Sentences with licence words that license nothing: for training, then for calibration only.
OTHER: tuple[str, ...] = (
    "The driver lost his license after the second accident.", "She is licensed to practise medicine in three states.", "A fishing license costs ten dollars and is valid for one season.",
    "The Apache helicopter flew over the valley at dawn.", "The Apache people lived in the southwest.", "The gnu and the zebra graze together on the plain.", "Students at MIT built a robot that can climb stairs.",
    "He studied physics at MIT and later taught there.", "MIT", "Apache", "He asked for permission to leave the table early.", "The copyright office opened a new reading room.",
    "The town released a report on public transport.", "Mozilla organised a conference about the open web.", "The general public was invited to the creative workshop in the commons.",
    "Redistribution of income was the subject of the debate.", "The version of the story that was released under pressure is 2.0 pages long.", "Poetic license allows a writer to bend the facts.",
    "The warranty on the car expired after three years.", "A licence to keep dogs was introduced in the last century.", "Under the terms of the agreement the work is to be done by May.",
    "His license plate was reported to the police.", "The bar had its liquor license renewed without restriction.", "The software was distributed on disks, free of charge, to any person who asked.",
    "Attribution of the painting to the master is disputed.", "This license is not mentioned anywhere else.", "The public domain includes parks and roads.", "All seats are reserved for members.",
    "A copy of the book may be obtained at the library.", "The file is part of the archive.", "Version 2.0 of the program was faster than version 1.1.", "The general public has a right to know.",
    "The foundation published a list of free concerts.", "You may use this road at your own risk.", "The terms of the treaty were modified in 1903.", "The driving licence was issued without any test.",
    "He sold copies of the newspaper without a license.", "The conditions of the contract were met.", "Software for offices is sold in many forms.", "The article is about the use of source code in schools.",
    "Commercial use of the river began in 1850.", "All rights of the workers were respected.", "Creative writing is taught on Mondays.", "The Mozilla browser was released in 2004.", "The BSD operating systems run on many machines.",
    "Permission to enter was granted by the guard.", "The university licensed the patent to a company.", "Proprietary recipes are kept in the safe.", "The commons were fenced in by the lords.",
    "Free software and open standards were the subject of her talk.", "He read the general terms and went to bed.", "The international association met in 3.0 hours.", "a license", "license", "terms of the", "under the",
    "Everyone may copy the recipe.", "The work is 4.0 metres long and stands in the public garden.", "by the author", "The compiled version was slower.", "No warranty was given.", "The zero was introduced by mathematicians.",
)
HELD_OTHER: tuple[str, ...] = (
    "The pilot renewed her license in Boston.", "The library at MIT is open to the general public.", "An Apache chief signed the treaty under pressure.", "The public license office is closed on Mondays.",
    "Copyright law was changed in the last session.", "The terms of the loan were published in the paper.", "Modified cars are not permitted on public roads without a license.", "The source of the river was found by a free man.",
    "The company reserved the right to change the conditions.", "He was granted permission to copy the old map.", "A new version of the play is distributed by the theatre.", "Members of the commons gave their attribution of blame.",
    "Confidential talks were held in the capital.", "The BSD society met at noon.", "This is the public domain of the king.", "License fees went up by 4.0 percent.",
)
FILLER = "the of and to in for on with as by from this that file project author holder code see notes below page data text is at it an".split()
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: A line break that ends a paragraph: after the end of a sentence, or before a line without letters or digits.
BREAK = r"""(?<=[.!?]["')\]]{0,2}[ \t\r]{0,8})\n|\n(?=[^A-Za-z0-9\n]*(?:\n|\z))"""
CONFIRM = 0.6
SEED = 7
#: Weights are whole numbers of this part, so that sums don't depend on their order.
UNIT = 10_000
SLOTS = 256


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(text: str) -> list[str]:
    """Distinct word 1- and 2-grams, as the scan makes them."""
    own = words(text)
    return list(dict.fromkeys(own + [f"{a} {b}" for a, b in zip(own, own[1:])]))


def split_paragraphs(text: str) -> list[str]:
    """The paragraphs of a text, written apart from the scan's pattern."""
    out, held = [], []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        held.append(line)
        blank_next = i + 1 < len(lines) and not re.search("[A-Za-z0-9]", lines[i + 1])
        if blank_next or re.search(r"""[.!?]["')\]]{0,2}[ \t\r]{0,8}\Z""", line):
            out.append("\n".join(held))
            held = []
    return out if not held else [*out, "\n".join(held)]


def variations(text: str, rng: random.Random, times: int) -> list[str]:
    """The text with words lost or added around it."""
    out = [text]
    for _ in range(times - 1):
        own = [w for w in text.split() if rng.random() > 0.06]
        before = [rng.choice(FILLER) for _ in range(rng.randrange(0, 5))]
        after = [rng.choice(FILLER) for _ in range(rng.randrange(0, 9))]
        out.append(" ".join(before + own + after))
    return out


def families() -> tuple[str, ...]:
    return (*NOTICES, UNKNOWN)


def framed(frames: tuple[str, ...], family: str) -> list[str]:
    return [f.format(n) for n in NAMES.get(family, ()) for f in frames if f != "{}" or n not in ("MIT", "BSD", "ISC", "Apache 2")]


@functools.cache
def templates() -> dict[str, list[list[str]]]:
    """For each family the gram lists that a paragraph is compared with: 2-grams, or the word if there is one only."""
    out = {}
    for family in NOTICES:
        lists = (([g for g in grams(t) if " " in g] or grams(t)) for t in (*NOTICES[family], *framed(FRAMES, family)))
        out[family] = [list(t) for t in dict.fromkeys(map(tuple, lists))]
    return out


@dataclass(frozen=True)
class LicenseModel:
    families: tuple[str, ...]  # the last one is UNKNOWN
    weights: dict[str, tuple[int, ...]]  # gram -> weight per family, in units
    bias: tuple[int, ...]
    temperature: float
    least: float

    def probabilities(self, text: str) -> np.ndarray:
        z = np.array(self.bias)
        for g in grams(text):
            if g in self.weights:
                z = z + np.array(self.weights[g])
        z = z / (UNIT * self.temperature)
        e = np.exp(z - z.max())
        return e / e.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def likeness(text: str, family: str) -> float:
    """The share of its 2-grams that the text has in common with the family's nearest template."""
    own, n = set(grams(text)), len(words(text))
    return max((len(own & set(t)) / max(1, min(n - 1, len(t))) for t in templates().get(family, ())), default=0.0)


def _rows(notices, frames, other, rng: random.Random, times: int) -> list[tuple[str, int, float]]:
    """(text, class, weight): every class weighs the same, however many names it has."""
    out = []
    for k, family in enumerate(families()):
        own = list(other) if family == UNKNOWN else [*notices.get(family, ()), *framed(frames, family)]
        # Names in frames are many already: half the variations.
        many = {*framed(frames, family)}
        made = [v for t in own for v in variations(t, rng, times // 2 if t in many else times)]
        share = 3.0 if family == UNKNOWN else 1.0
        out += [(v, k, share / len(made)) for v in made]
    return out


@functools.cache
def trained_model(rounds: int = 250, l1: float = 4e-5) -> LicenseModel:
    """Proximal gradient descent; same result every time."""
    rng = random.Random(SEED)
    fit = _rows(NOTICES, FRAMES, OTHER, rng, 4)
    held = _rows(HELD_NOTICES, HELD_FRAMES, HELD_OTHER, rng, 4)
    count: dict[str, int] = {}
    for text, *_ in fit:
        for g in grams(text):
            count[g] = count.get(g, 0) + 1
    # Filler words alone say nothing; within 2-grams they may.
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in count.items() if n > 2 and g not in FILLER))}

    def matrix(part):
        x = np.zeros((len(part), len(vocabulary)), np.float32)
        for i, (text, *_) in enumerate(part):
            for g in grams(text):
                if g in vocabulary:
                    x[i, vocabulary[g]] = 1
        share = np.array([w for *_, w in part])
        return x, np.eye(len(families()), dtype=np.float32)[[k for _, k, _ in part]], (share / share.sum()).astype(np.float32)

    x, y, share = matrix(fit)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    b[-1] = 1.0
    speed, step = np.sqrt(share)[:, None] * x, None
    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):  # the largest eigenvalue sets the step
        v = speed.T @ (speed @ v)
        v /= np.linalg.norm(v)
    step = 2.0 / float(v @ (speed.T @ (speed @ v)))
    w0, t0, ahead = w, 1.0, w
    for _ in range(rounds):
        gap = (_softmax(x @ ahead + b) - y) * share[:, None]
        w = ahead - step * (x.T @ gap)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b = b - step * gap.sum(axis=0)
        t1 = (1 + (1 + 4 * t0 * t0) ** 0.5) / 2
        ahead, w0, t0 = w + (t0 - 1) / t1 * (w - w0), w, t1
    w, b = np.rint(w.astype(float) * UNIT).astype(int), np.rint(b.astype(float) * UNIT).astype(int)
    hx, hy, hshare = matrix(held)
    z = (hx.astype(float) @ w + b) / UNIT
    loss = lambda t: float((-np.log((_softmax(z / t) * hy).sum(axis=1) + 1e-12) * hshare).sum())
    temperature = round(float(min(np.arange(0.25, 4.01, 0.05), key=loss)), 2)
    p = _softmax(z / temperature)[:, :-1]
    passing = [float(q.max()) for (text, k, _), q in zip(held, p) if families()[k] == UNKNOWN and likeness(text, families()[int(q.argmax())]) >= CONFIRM]
    least = round(max([0.5, *(q + 1e-4 for q in passing)]), 4)  # no held-out unknown is accepted
    weights = {g: tuple(w[i].tolist()) for g, i in vocabulary.items() if w[i].any()}
    return LicenseModel(families(), weights, tuple(b.tolist()), temperature, least)


def _constant(value, kind: str) -> str:
    """A constant of a nested type: folded once when the query is planned."""
    said = json.dumps(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{said}', '{kind}')"


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """One row per document: key, n_paragraphs and ``found``, the paragraphs of a family in order:
    array<struct<paragraph, family, probability, similarity, confirmed>>."""
    model = model or trained_model()
    known = {*model.weights, *(g for ts in templates().values() for t in ts for g in t)}
    ones, pairs = {g for g in known if " " not in g}, {g for g in known if " " in g}
    slots: list[dict[str, tuple[int, ...]]] = [{} for _ in range(SLOTS)]
    for g, w in model.weights.items():
        slots[zlib.crc32(g.encode()) % SLOTS][g] = w
    n = len(model.families)
    weights = _constant(slots, "array<map<string,array<bigint>>>")
    bias, none = _constant(list(model.bias), "array<bigint>"), _constant([0] * n, "array<bigint>")
    names = _constant(list(model.families), "array<string>")
    forms = _constant(templates(), "map<string,array<array<string>>>")

    rows = columns_of(docs, key=key, text=text).select("key", F.split("text", BREAK, -1).alias("parts"))
    # Words of every paragraph, then those grams that the model or a template knows. Most paragraphs have none.
    steps = (
        ("held", f"""filter(transform(transform(parts, p -> regexp_extract_all(lower(p), '{WORD.replace(chr(92), chr(92) * 2)}', 0)), (w, i) -> named_struct(
            'paragraph', i, 'n', size(w), 'held', array_distinct(concat(filter(w, x -> x IN ({_listed(ones)})), filter(
              zip_with(w, slice(w, 2, size(w)), (a, b) -> CASE WHEN a IN ({_listed({g.split(' ')[0] for g in pairs})}) THEN concat(a, ' ', b) END), x -> x IN ({_listed(pairs)})))))),
            s -> size(s.held) > 0)"""),
        ("scored", f"""transform(held, s -> named_struct('paragraph', s.paragraph, 'n', s.n, 'held', s.held, 'z', transform(aggregate(s.held, {bias}, (acc, g) ->
            zip_with(acc, coalesce(try_element_at(element_at({weights}, cast(crc32(g) % {SLOTS} as int) + 1), g), {none}), (a, b) -> a + b)), z -> z / ({UNIT} * {model.temperature}D))))"""),
        ("chosen", f"""filter(transform(scored, s -> named_struct('paragraph', s.paragraph, 'n', s.n, 'held', s.held, 'family', element_at({names}, cast(array_position(s.z, array_max(s.z)) as int)),
            'p', 1 / aggregate(s.z, 0D, (acc, z) -> acc + exp(z - array_max(s.z))))), s -> s.family != '{UNKNOWN}' AND s.p >= {model.least}D)"""),
        ("compared", f"""transform(chosen, s -> named_struct('paragraph', s.paragraph, 'family', s.family, 'p', s.p, 'similarity', aggregate(element_at({forms}, s.family), 0D,
            (acc, t) -> greatest(acc, size(array_intersect(s.held, t)) / greatest(1, least(s.n - 1, size(t))))) ))"""),
        ("found", f"""transform(compared, s -> named_struct('paragraph', cast(s.paragraph as bigint), 'family', s.family, 'probability', round(s.p, 4), 'similarity', round(s.similarity, 4), 'confirmed', s.similarity >= {CONFIRM}D))"""),
    )
    rows = rows.select("key", F.size("parts").cast("bigint").alias("n_paragraphs"), F.expr(steps[0][1]).alias("held"))
    for name, said in steps[1:]:
        rows = rows.select("key", "n_paragraphs", F.expr(said).alias(name))
    return rows.withColumnRenamed("key", key)


def license_report(docs: DataFrame) -> DataFrame:
    """The columns of query ``op1_license_scan``: one row per document."""
    rows = paragraphs(docs)
    sure = F.filter("found", lambda x: x["confirmed"])
    named = F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"])))
    return rows.select(
        "doc_id", "n_paragraphs",
        F.size("found").cast("bigint").alias("n_found"),
        F.size(sure).cast("bigint").alias("n_licensed"),
        F.array_join(named, ",").alias("families"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["paragraph"], x["family"], F.format_string("%.4f", x["probability"]), F.format_string("%.4f", x["similarity"]))), ",").alias("paragraphs"),
    )
