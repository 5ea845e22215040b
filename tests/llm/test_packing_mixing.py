import collections
import random
import re
import struct
import zlib

import pytest

from gleanery.llm import bestfit_packing as B
from gleanery.llm import source_mixing as M
from gleanery.llm.token_codec import DEFAULT_TOKENIZER, encoder


def test_pieces():
    assert B.piece_bounds(1) == [(0, 1)] and B.piece_bounds(2048) == [(0, 2048)]
    assert B.piece_bounds(2049) == [(0, 1), (1, 2048)] and B.piece_bounds(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def test_sum_of_squares_choice():
    """Each choice is the one that a full recount of the squares prefers."""
    rng = random.Random(4)
    bins = B.SumOfSquares(20)
    fill = {}
    for _ in range(300):
        size = rng.randrange(1, 21)
        gaps = {b: 20 - f for b, f in fill.items()}
        room = [b for b, g in gaps.items() if g >= size]
        number, offset = bins.place(size)
        assert offset == fill.get(number, 0)

        def squares(b):
            after = collections.Counter(g - size * (k == b) for k, g in gaps.items())
            return sum(n * n for g, n in after.items() if g)

        if room:
            assert number in room and squares(number) == min(map(squares, room))
        fill[number] = offset + size
        assert fill[number] <= 20
    with pytest.raises(ValueError):
        bins.place(21)


def test_pack_documents(docs, rows, none):
    own = encoder(DEFAULT_TOKENIZER)
    got = B.pack_documents(docs, with_ids=True).collect()
    assert sum(r["piece"] == 0 for r in got) == len(rows)
    texts = collections.defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(tuple([*own.whole(t or ""), 0]))
    for r in got:
        ids = next(iter(texts[r["doc_id"]]))[r["start"] : r["start"] + r["length"]]
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert r["ids"] == raw and r["ids_crc32"] == zlib.crc32(raw)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 2
    assert B.pack_documents(none).count() == 0


def test_water_fill():
    assert M.water_fill(15, [3, 1, 2], [100, 100, 100]) == [7.5, 2.5, 5.0]
    got = M.water_fill(60, [3, 1, 2], [10, 100, 20])
    assert got == [10, 30, 20] and M.water_fill(0, [1], [0]) == [0.0] and M.water_fill(1, [], []) == []


def test_mix(docs, rows, none):
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = ["a", "b", "c", None]
    caps = [2 * sizes[s] for s in order]
    want = dict(zip(order, M.water_fill(1.5 * sum(sizes.values()), [3, 1, 2, 3], caps)))
    copies = collections.defaultdict(list)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        copies[r["source"]].append(r["copies"])
    for s, c in copies.items():
        expected = want[s] / sizes[s] if sizes[s] else 0
        assert abs(sum(c) - expected * len(c)) <= 1 and max(c) - min(c) <= 1
    again = M.mix(docs.repartition(7)).select("doc_id", "copies", "size").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in M.mix(docs).select("doc_id", "copies", "size").collect())
    taken = M.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in got)
    assert M.mix(none).count() == 0 and M.take(none).count() == 0


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    for n in (0, 1, 2, 40, 700):
        totals = [(f"site{i:04d}" if i else None, rng.choice([0, 1, 5, 300, 20_000, rng.randrange(1_000_000)])) for i in range(n)]
        got = {r["src"]: r for r in M.targets(spark.createDataFrame(totals, "src string, source_size bigint").repartition(5)).collect()}
        order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
        want = M.water_fill(1.5 * sum(x for _, x in order), [M.WEIGHTS[i % 3] for i in range(n)], [2 * x for _, x in order])
        assert len(got) == n
        for (s, size), t in zip(order, want):
            assert abs(got[s]["target"] - t) <= 1e-6 * max(1, t) and got[s]["offset"] == M.offset(s)
            assert got[s]["each"] == (min(2 * M.UNIT, round(t / size * M.UNIT)) if size else 0)


def test_ties_and_clashing_names(spark):
    names = "`doc_id` bigint, `text` string, `source` string, `row` int, `a.b` string, `src` int, `pos` int, `key` int, `c0` int"
    rows = [(i % 2, f"word{i} b c", "s", i, str(i), i, i, i, i) for i in range(30)] + [(None, None, None, 0, None, 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, names)
    first = sorted(map(str, M.take(docs).collect()))
    assert M.take(docs).columns == docs.columns
    for n in (1, 3, 8):
        assert sorted(map(str, M.take(docs.repartition(n)).collect())) == first


def test_ranks_are_systematic(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "s") for i in range(40)], "doc_id bigint, text string, source string")
    got = sorted(M.mix(docs, total=0.4).collect(), key=lambda r: r["size"])
    each = min(2 * M.UNIT, round(got[0]["target"] / got[0]["source_size"] * M.UNIT))
    place = M.offset("s")
    for r in got:
        assert r["copies"] == (place + each) // M.UNIT - place // M.UNIT
        place += each
