import re

import numpy as np
import xxhash

from gleanery.llm import simhash_dedup as H
from gleanery.llm.components import components


def slow_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, pairs):
    parent = list(range(n))
    for a, b in pairs:
        a, b = H._find(parent, a), H._find(parent, b)
        parent[max(a, b)] = min(a, b)
    return [H._find(parent, i) for i in range(n)]


def test_report(docs, rows, none):
    got = H.fingerprint_report(docs).collect()
    assert len(got) == len(rows)
    prints = {i: {slow_print(t) for j, t, _ in rows if j == i} for i, _, _ in rows}
    for r in got:
        assert int(r["fingerprint"], 16) in prints[r["doc_id"]]
    keys = [i for i, _, _ in rows if i is not None]
    fp = [slow_print(t) for i, t, _ in rows if i is not None]
    root = classes(len(fp), [(a, b) for a in range(len(fp)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 2])
    least = {}
    for k, r in zip(keys, root):
        least[r] = min(least.get(r, k), k)
    want = {k: least[r] for k, r in zip(keys, root)}
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert H.fingerprint_report(none).count() == 0
    kept = H.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*want.values(), None}


def test_large_groups_are_dealt_again(spark):
    rng = np.random.default_rng(5)
    mask = H.block_masks()[3]
    free = [b for b in range(64) if not mask >> b & 1]
    base = 0x0123456789ABCDEF
    values = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(free, int(rng.integers(0, 8)), replace=False)) for _ in range(400)], np.uint64))
    nodes = spark.createDataFrame([(H._signed(int(v)), i) for i, v in enumerate(values)], "fp bigint, node bigint").repartition(3)
    want = classes(len(values), H.link_group(values))
    for direct in (1, 20, 10_000):
        found = H.links(nodes, direct=direct).collect()
        assert all(bin(int(values[r["a"]]) ^ int(values[r["b"]])).count("1") <= 2 for r in found)
        assert classes(len(values), [(r["a"], r["b"]) for r in found]) == want
    assert len(set(want)) > 1


def test_finer_masks_keep_close_pairs():
    rng = np.random.default_rng(6)
    for mask in H.block_masks():
        free = [b for b in range(64) if not mask >> b & 1]
        finer = H.finer_masks(mask)
        assert all(bin(m).count("1") >= 50 for m in finer)
        for _ in range(50):
            gap = sum(1 << int(b) for b in rng.choice(free, 2, replace=False))
            assert any(not gap & m for m in finer)


def test_hot_fingerprints(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c d" if i % 2 else f"text {i} of its own") for i in range(40)], "doc_id bigint, text string")
    want = sorted(map(str, H.fingerprint_report(docs).collect()))
    monkeypatch.setattr(H, "HOT_ROWS", 5)
    assert sorted(map(str, H.fingerprint_report(docs).collect())) == want
    monkeypatch.setattr(H, "MOST_BROADCAST", 0)
    assert sorted(map(str, H.fingerprint_report(docs).collect())) == want


def test_clashing_names(spark):
    names = "`doc_id` bigint, `text` string, `__keep` int, `a.b` string, `fp` int, `component_id` int, `key` int"
    docs = spark.createDataFrame([(1, "one two three four", 1, "x", 1, 1, 1), (2, "one two three four", 2, "y", 2, 2, 2), (3, None, 3, "", 3, 3, 3)], names)
    kept = H.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_blocks_find_every_close_pair(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    values = set(base)
    for v in base:
        for d in (1, 2, 3):
            values.add(v ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    values = sorted(values)
    signed = [H._signed(v) for v in values]
    found = H.links(spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp bigint, node bigint")).collect()
    close = [(a, b) for a in range(len(values)) for b in range(a) if bin(values[a] ^ values[b]).count("1") <= 2]
    assert classes(len(values), [(r["a"], r["b"]) for r in found]) == classes(len(values), close)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 2000), (5, 5)], "a bigint, b bigint")
    got = {r["a"]: r["b"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {2000: 1000}
    assert components(edges.limit(0)).count() == 0


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(500, i) for i in range(501, 560)] + [(600, i) for i in range(561, 600)]
    nodes = sorted({x for p in pairs for x in p})
    root = classes(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in pairs])
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {n: nodes[r] for n, r in zip(nodes, root) if nodes[r] != n}
