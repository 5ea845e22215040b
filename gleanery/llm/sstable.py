"""Token ids in sorted-string-table shards.

A shard is one file, written once, its keys in ascending order::

    block*  index  bloom  footer

block   zstd frame of entries (varint shared, varint rest, varint value size, key bytes
        after the shared prefix, value). The first entry of a block shares nothing.
index   per block: key of its first entry, offset, size, entries, ids before it in the shard
bloom   bits of a Bloom filter over all keys (10 bits a key, 7 probes)
footer  fixed size: places of index and Bloom filter, documents, ids, bytes per id, magic

A lookup reads the footer, index and Bloom filter once, then one block: it asks the filter,
finds the block by binary search and reads it. Keys are document ids as 8 bytes whose order
is that of the integers (null: the empty key, first). Values are ids, little-endian.

Shards are written by tasks that hold one range of ids each, to the shared folder under
names that no other attempt uses; only the table of shards (one row each) says which files
count, so lost executors and repeated attempts leave at most files that no one reads.

Rows are dealt by ranges of (id, hash of the text, row), so that an id shared by a third of
all rows (null, say) spreads over many shards.

Defined results: null text is empty, so its document holds the end id alone; texts are
encoded whole, however long; ids are integers (other types are refused); rows that repeat an
id are kept, one after another (by a hash of the text); empty tables write no shard; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.shared import batches_of, columns_of, integer_column, scratch_path, stash
from gleanery.llm.token_codec import DEFAULT_TOKENIZER, encoder
from gleanery.session import ship_package

MAGIC = b"GLSST001"
_FOOTER = struct.Struct("<QQQQQQHH8s")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 256 << 20
BITS_PER_KEY, PROBES = 10, 7
END = 2


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    from xxhash import xxh3_128_intdigest

    both = xxh3_128_intdigest(key)
    a, b = both & ((1 << 64) - 1), both >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, sink, width: int):
        import zstandard

        self.sink, self.width = sink, width
        self.zip = zstandard.ZstdCompressor(level=1)
        self.at = self.docs = self.ids = 0
        self.first = self.last = None
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self._start()

    def _start(self) -> None:
        self.block, self.block_first, self.block_docs, self.block_ids, self.before = bytearray(), b"", 0, self.ids, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys out of order")
        shared = 0
        if self.block_docs:
            while shared < len(key) and shared < len(self.before) and key[shared] == self.before[shared]:
                shared += 1
        else:
            self.block_first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.before = self.last = key
        if self.first is None:
            self.first = key
        self.block_docs += 1
        self.docs += 1
        self.ids += len(value) // self.width
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block_docs:
            data = self.zip.compress(bytes(self.block))
            self.sink.write(data)
            self.index.append((self.block_first, self.at, len(data), self.block_docs, self.block_ids))
            self.at += len(data)
        self._start()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QIIQ", *rest) for k, *rest in self.index)
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.sink.write(index)
        self.sink.write(bytes(bloom))
        self.sink.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, self.width, PROBES, MAGIC))
        self.sink.close()


class ShardReader:
    """Random access to one shard: ``get`` by id, ``scan`` in order."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        raw = self._at(size - _FOOTER.size, _FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.docs, self.ids, self.width, self.probes, magic = _FOOTER.unpack(raw)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.kind = np.dtype(f"<u{self.width}")
        index = self._at(index_at, index_size)
        self.blocks, at = [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.blocks.append((index[at : at + n], *struct.unpack_from("<QIIQ", index, at + n)))
            at += n + 24
        self.firsts = [b[0] for b in self.blocks]
        self.bloom = self._at(bloom_at, bloom_size)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        _, offset, size, docs, _ = self.blocks[block]
        data = zstandard.ZstdDecompressor().decompress(self._at(offset, size))
        at, key = 0, b""
        for _ in range(docs):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def may_hold(self, key: bytes) -> bool:
        bits = max(64, BITS_PER_KEY * self.docs)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of the (first) document with this id, or None."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return None
        block = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while block < len(self.blocks) and self.firsts[block] <= key:
            for k, value in self._entries(block):
                if k == key:
                    return np.frombuffer(value, self.kind)
                if k > key:
                    return None
            block += 1
        return None

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.blocks)):
            for key, value in self._entries(block):
                yield id_of(key), np.frombuffer(value, self.kind)

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER, end: int = END) -> DataFrame:
    """Encode every text, write shards under ``folder`` (default: a new one in the shared folder), and
    return the table of shards: path, first_id, last_id, n_docs, n_tokens, start (ids in all shards before)."""
    integer_column(docs, key)
    spark = ship_package(docs.sparkSession)
    folder = (folder or scratch_path(spark, "shards")).rstrip("/")
    store, inside = fs.FileSystem.from_uri(folder)
    store.create_dir(inside, recursive=True)
    rows = columns_of(docs, key=key, text=text).select(F.col("key").cast("bigint").alias("key"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "text")
    order = (F.col("key").asc_nulls_first(), "hash", "row")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches):
        own = encoder(tokenizer)
        kind = own.kind if end < 1 << 16 else np.dtype("<u4")
        tail = end.to_bytes(kind.itemsize, "little")
        writer, path, first, shards = None, None, None, []
        store, inside = fs.FileSystem.from_uri(folder)

        def done():
            if writer:
                writer.close()
                shards.append((path, id_of(writer.first), *first, id_of(writer.last), writer.docs, writer.ids))

        for batch in batches_of(batches):
            ids, offsets = own.encode(batch.column(3))
            raw, width, bounds = ids.astype(kind).tobytes(), kind.itemsize, offsets.tolist()
            for i, (doc_id, *tie) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if writer is None or writer.at > SHARD_BYTES:
                    done()
                    first = tie
                    name = f"shard-{uuid.uuid4().hex}.sst"
                    path = f"{folder}/{name}"
                    writer = ShardWriter(store.open_output_stream(f"{inside}/{name}"), width)
                writer.add(key_of(doc_id), raw[bounds[i] * width : bounds[i + 1] * width] + tail)
        done()
        columns = list(zip(*shards)) if shards else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

    names = ["path", "first_id", "first_hash", "first_row", "last_id", "n_docs", "n_tokens"]
    table = stash(ranged.mapInArrow(write, "path string, " + ", ".join(f"{n} bigint" for n in names[1:])), "shard-table")
    # One row per shard goes through this window, none per document.
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash", "first_row").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("first_hash", "first_row")


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document in the shards: doc_id, start, n_tokens, ids_crc32 (of ids as 4 bytes each)."""
    n = max(1, shards.count())

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(path)
                rows: list[tuple] = []
                for doc_id, ids in reader.scan():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _table(rows)
                        rows = []
                reader.close()
                yield _table(rows)

    dealt = shards.select("path", "start").repartition(n, "path")
    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(shards: DataFrame, ids: list[int]) -> dict[int, np.ndarray]:
    """Token ids of some documents, by footer, Bloom filter, binary search and one block each.

    Only the shards whose range holds one of the ids reach the driver.
    """
    asked = F.array(*map(F.lit, {x for x in ids if x is not None})).cast("array<bigint>")
    may = F.exists(asked, lambda x: (F.coalesce(F.col("first_id"), F.lit(-1 << 63)) <= x) & (x <= F.col("last_id")))
    if None in ids:
        may = F.coalesce(may, F.lit(False)) | F.col("first_id").isNull()
    table = shards.where(may).orderBy("start").select("path", "first_id", "last_id").collect()
    out = {}
    for path, first, last in table:
        here = [x for x in ids if x not in out and key_of(first) <= key_of(x) <= key_of(last)]
        if here:
            reader = ShardReader(path)
            got = ((x, reader.get(x)) for x in here)
            out.update((x, found) for x, found in got if found is not None)
            reader.close()
    return out


def shard_report(docs: DataFrame) -> DataFrame:
    """Write, read back, and give the columns of query ``op6_sstable_shards``."""
    return read_shards(write_shards(docs))
