"""Sum-of-squares packing of token sequences into bins of fixed capacity.

A document longer than a bin is cut into full pieces behind a first one that may be
shorter. Items are packed longest first. An item goes to an open bin with room, the one
for which the sum over gaps of (open bins with that gap) squared becomes smallest (on a tie
the tightest); a new bin is opened only when none has room.

Gaps are at most ``capacity``, so the state is a count per gap and the bins themselves.
Items are dealt evenly by hash to shards of about ``per_shard`` items, whose sizes are
distributed alike; each shard is packed on its own, in one streaming pass over its items
sorted by length. A shard wastes about one bin, whatever the size of the input.

Defined results: null text is an empty document of one token (the end); texts are encoded
whole, however long; repeated rows are packed as often as they occur; ties in length are
broken by row; empty tables give no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import batches_of, columns_of, place, stash
from gleanery.llm.token_codec import DEFAULT_TOKENIZER, encoder
from gleanery.session import ship_package

CAPACITY = 2048
PER_SHARD = 8192
END = 0


def piece_bounds(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    if not tokens:
        return []
    head = (tokens - 1) % capacity + 1
    return [(0, head), *((at, capacity) for at in range(head, tokens, capacity))]


class SumOfSquares:
    """Bins by gap. ``place`` gives (bin, offset in it)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full ones don't count
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        if not 0 < size <= self.capacity:
            raise ValueError(f"an item of {size} in bins of {self.capacity}")
        fits = self.count[size : self.capacity]
        gaps = np.flatnonzero(fits)
        if len(gaps):
            # Moving a bin from gap g to g - size changes the sum by 2 (n[g - size] - n[g] + 1), or by
            # 1 - 2 n[g] if it becomes full; halves of these are compared.
            change = np.where(gaps == 0, 0.5 - fits[gaps], self.count[gaps] - fits[gaps] + 1.0)
            gap = size + int(gaps[np.argmin(change)])
            number = self.open[gap].pop()
            self.count[gap] -= 1
        else:
            gap, number = self.capacity, self.bins
            self.bins += 1
        if gap > size:
            self.open[gap - size].append(number)
            self.count[gap - size] += 1
        return number, self.capacity - gap


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: row (unique), key, piece, start, length, ids_crc32, and ids if asked for."""
    ship_package(docs.sparkSession)
    kind = docs.schema.fields[place(docs, key)].dataType.simpleString()

    def run(batches):
        own = encoder(tokenizer)
        for batch in batches_of(batches):
            ids, offsets = own.encode(batch.column(2))
            wide = ids.astype("<u4")
            index, number, start, length, crc, raw = [], [], [], [], [], []
            bounds = offsets.tolist()
            for i in range(batch.num_rows):
                data = wide[bounds[i] : bounds[i + 1]].tobytes() + end.to_bytes(4, "little")
                view = memoryview(data)
                for k, (a, n) in enumerate(piece_bounds(len(data) // 4, capacity)):
                    index.append(i)
                    number.append(k)
                    start.append(a)
                    length.append(n)
                    part = view[4 * a : 4 * (a + n)]
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(bytes(part))
            at = pa.array(index, pa.int32())
            arrays = [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["row", "key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = columns_of(docs, key=key, text=text).select(F.monotonically_increasing_id().alias("row"), "key", "text")
    shape = f"row bigint, key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return rows.mapInArrow(run, shape).withColumnRenamed("key", key)


def pack_items(items: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """``items`` (row, piece, length, ...) with sequence_id and offset. ``items`` is read twice: give a table."""
    ship_package(items.sparkSession)
    shards = max(1, -(-items.count() // per_shard))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("bigint"))
    order = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "row", "piece")
    at_length, at_shard = items.columns.index("length"), len(items.columns)

    def run(batches):
        now, bins = None, SumOfSquares(capacity)
        for batch in batches:
            where, offset = [], []
            for size, shard in zip(batch.column(at_length).to_pylist(), batch.column(at_shard).to_pylist()):
                if shard != now:
                    now, bins = shard, SumOfSquares(capacity)
                number, place = bins.place(size)
                where.append(number * shards + shard)
                offset.append(place)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at_shard)), pa.array(where, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names[:at_shard], "sequence_id", "offset"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id bigint, offset bigint"
    return order.mapInArrow(run, shape)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Where every piece of every document lies: the columns of query ``op9_bestfit_packing`` (and ids if asked for)."""
    made = stash(pieces(docs, key, text, tokenizer, capacity, end, with_ids), "pieces")
    return pack_items(made, capacity).drop("row")
