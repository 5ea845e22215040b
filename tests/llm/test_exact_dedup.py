import collections
import hashlib
import random
import re

import pytest

from gleanery.llm import exact_dedup as X


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_groups(docs, rows, none):
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i or 0, i))
    got = X.duplicate_groups(docs).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(plain(t))
    for r in got:
        own = texts[r["doc_id"]][0]
        best = min(groups[own])
        assert r["keep_id"] == best[3] and r["group_size"] == len(groups[own])
        assert r["text_sha256"] == hashlib.sha256(own.encode()).hexdigest()
    assert sum(r["kept"] for r in got) == len(groups)
    assert X.duplicate_groups(none).count() == 0


def test_drop(docs, rows, none):
    kept = X.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(plain(r["text"]) for r in kept.collect()) == sorted({plain(t) for _, t, _ in rows})
    assert X.drop_duplicates(none).count() == 0


def test_spilling_is_exact(tmp_path):
    rng = random.Random(1)
    contents = [f"{rng.randrange(300)}".encode() * 20 for _ in range(3000)]
    records = [(X._hash(c), X.best_of(len(c), i, i), 1, c, b"") for i, c in enumerate(contents)]
    small = X.GraceDedup(budget=3000, folder=str(tmp_path))
    got = {c: (best[-1], n, first, len(rows) // 8) for best, n, first, c, rows, _ in small.groups(iter(records), "pack")}
    assert small.spilled and small.deepest >= 2 and not list(tmp_path.iterdir())
    count = collections.Counter(contents)
    assert got == {c: (contents.index(c), n, contents.index(c), n) for c, n in count.items()}
    told = [x for x in X.GraceDedup(budget=3000, folder=str(tmp_path)).groups(iter(records), "emit") if len(x) == 2]
    assert sorted((best[-1], first) for first, best in told) == [(i, contents.index(c)) for i, c in enumerate(contents)]


def test_equal_hashes_are_told_apart(tmp_path):
    records = [(5, X.best_of(1, i, i), 1, c, b"") for i, c in enumerate([b"a", b"b", b"a", b"c"])]
    got = {c: n for _, n, _, c, _, _ in X.GraceDedup(budget=1, folder=str(tmp_path)).groups(iter(records))}
    assert got == {b"a": 2, b"b": 1, b"c": 1}


def test_small_budgets_give_the_same(docs, rows):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(map(str, X.duplicate_groups(docs).select(columns).collect()))
    assert sorted(map(str, X.duplicate_groups(docs, budget=500).select(columns).collect())) == want


def test_largest_and_null_ids(spark):
    last = (1 << 63) - 1
    docs = spark.createDataFrame([(last, "a b"), (None, "ab"), (last, "c"), (-last - 1, "c"), (None, "d"), (None, "d")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in X.duplicate_groups(docs).collect()), key=str)
    assert got == sorted([(last, last, 2, True), (None, last, 2, False), (last, -last - 1, 2, False), (-last - 1, -last - 1, 2, True), (None, None, 2, True), (None, None, 2, False)], key=str)


def test_clashing_names_and_ties(spark):
    names = "`doc_id` bigint, `text` string, `code` int, `CODE ` int, `__code` int, `a.b` string, `c0` int, `row` int"
    rows = [(i % 3, "same  text", i, i, i, str(i), i, i) for i in range(9)] + [(7, None, 0, 0, 0, "", 0, 0), (8, " ", 0, 0, 0, "", 0, 0)]
    docs = spark.createDataFrame(rows, names)
    kept = X.drop_duplicates(docs)
    assert kept.columns == docs.columns
    first = sorted(map(str, kept.collect()))
    assert len(first) == 2 and {r["doc_id"] for r in kept.collect()} == {0, 8}
    for n in (1, 5):
        assert sorted(map(str, X.drop_duplicates(docs.repartition(n)).collect())) == first
    assert X.duplicate_groups(docs).count() == len(rows)
    with pytest.raises(TypeError):
        X.duplicate_groups(docs.withColumn("doc_id", docs.text))
    with pytest.raises(TypeError):
        X.drop_duplicates(docs.withColumn("doc_id", docs.text))
