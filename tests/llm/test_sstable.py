import struct
import zlib

import pytest

from gleanery.llm import sstable as T
from gleanery.llm.token_codec import DEFAULT_TOKENIZER, encoder


def test_round_trip(docs, rows, none):
    own = encoder(DEFAULT_TOKENIZER)
    shards = T.write_shards(docs)
    got = sorted(T.read_shards(shards).collect(), key=lambda r: r["start"])
    start = 0
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*own.whole(t or ""), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    found = T.lookup(shards, [5, 9, 59, 1000, -7])
    assert found.keys() == {5, 9, 59} and list(found[5]) == [*own.whole("same text here"), 2]
    assert T.read_shards(T.write_shards(none)).count() == 0


def test_one_id_spreads_over_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_BYTES", 0)
    docs = spark.createDataFrame([(None if i % 3 else i, f"text {i % 50} " * 300, 1, "x") for i in range(400)] + [(7, "same", 1, "y")] * 40, "`doc_id` bigint, `text` string, `key` int, `a.b` string")
    shards = T.write_shards(docs.repartition(3))
    assert shards.where("first_id is null").count() > 1
    got = sorted(T.read_shards(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda x: (x is not None, x or 0))
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    found = T.lookup(shards, [None, 0, 7, 399, 400])
    own = encoder(DEFAULT_TOKENIZER)
    assert found.keys() == {None, 0, 7, 399} and list(found[7]) == [*own.whole("same"), 2]
    with pytest.raises(TypeError):
        T.write_shards(docs.withColumn("doc_id", docs.text))


def test_blocks_and_bloom(tmp_path):
    path = str(tmp_path / "x.sst")
    w = T.ShardWriter(open(path, "wb"), 2)
    keys = [None, *range(-500, 40_000, 7)]
    for k in keys:
        w.add(T.key_of(k), struct.pack("<H", (k or 0) % 65_000) * 12)
    w.close()
    r = T.ShardReader(path)
    assert len(r.blocks) >= 3 and r.docs == len(keys)
    assert [k for k, _ in r.scan()] == keys
    for k in (-500, 6, 39_999 // 7 * 7 - 500 % 7, None):
        assert (r.get(k) is not None) == (k in keys)
    missing = [k for k in range(100_000, 102_000)]
    assert sum(r.may_hold(T.key_of(k)) for k in missing) < 100


def test_pieces_equal_whole_texts():
    import pyarrow as pa

    odd = ["", "a  b", "a\n\nb", " a", "a ", "a\tb", "a b", "don't it's", "#### $$ a.b.c 3.5,2 a..., b!? c.\nd", "a\x00b", "<|endoftext|> x", "ſ ²½ 10²", "e., f", ". a", "3. b, c.\nD e,\nf", None, "é̀. b, 漢字, 仮."]
    own = encoder(DEFAULT_TOKENIZER)
    ids, at = own.encode(pa.array(odd))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(odd))] == [own.whole(x or "") for x in odd]
