"""Exact deduplication by Grace hashing: partition, spill, and compare whole contents.

Two texts are equal when they are identical after every ASCII white space character is
deleted. The row with the most code points in its original text, then the smallest id, stays.

1. Every input partition is deduplicated where it lies. Records are hashed; while they fit,
   they stay in an open-addressing table that compares complete contents. Beyond the memory
   budget they go to spill files by bits of the hash, and each file is treated alike with the
   next bits, until its records fit or are all one text. What leaves a partition is one
   representative per distinct text, and for each row, as soon as its text is found in the
   table, which representative it belongs to; so a text that fills a third of the table
   shrinks to one row per partition before anything is shuffled, and no list of rows is held.
2. Representatives are dealt by hash and deduplicated in the same way.
3. Each row looks up its representative's verdict, keyed by representative, so that even the
   rows of the largest group spread over as many keys as there were input partitions.

Spill files live and die inside one task; the table between 1 and 2 is in the shared folder.

Defined results: null counts as empty; a text of white space only equals the empty text;
texts are compared whole, however long; ids are integers (other types are refused), null
sorts after all; repeated ids are separate rows (of rows that tie in length and id one is
kept, ``kept`` is true for it alone); empty tables give no rows; other columns are ignored,
whatever they are called.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from gleanery.llm.shared import WHITE, batches_of, columns_of, integer_column, numbered, place, stash
from gleanery.session import ship_package

#: Bytes of record contents that one table may hold before it spills.
MEMORY_BUDGET = 64 << 20
FAN_OUT = 16
_HEAD = struct.Struct("<Qq?qQqqII")


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of an entry."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.best: list[Best] = []
        self.sizes: list[int] = []
        self.firsts: list[int] = []  # row of the entry's first record
        self.rows: list[bytearray] = []
        self.payloads: list[bytes] = []

    def find(self, code: int, content: bytes, add: bool = True) -> tuple[int, bool]:
        """(entry with this content, whether it is new); without ``add`` -1 if there is none."""
        slots, mask = self.slots, len(self.slots) - 1
        at = code & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == code and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        if not add:
            return -1, False
        slots[at] = entry = len(self.contents)
        self.hashes.append(code)
        self.contents.append(content)
        if 3 * len(self.contents) > 2 * len(slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self.slots = slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for entry, code in enumerate(self.hashes):
            at = code & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry


#: (-length, whether the id is null, id, tie, row): the least of a group's records stays.
Best = tuple[int, bool, int, int, int]
Record = tuple[int, Best, int, bytes, bytes]  # hash, best, size, content, payload
Group = tuple[Best, int, int, bytes, bytes, bytes]  # best, size, first row, content, rows packed, best's payload


def best_of(length: int, key: int | None, row: int, tie: int = 0) -> Best:
    return -length, key is None, key or 0, tie, row


class GraceDedup:
    """Groups records by content in bounded memory: contents within ``budget``, or one text alone."""

    def __init__(self, budget: int = MEMORY_BUDGET, folder: str | None = None):
        self.budget, self.folder = budget, folder
        self.spilled = 0
        self.deepest = 0

    def groups(self, records: Iterable[Record], rows: str = "none", level: int = 0) -> Iterator[Group | tuple[int, Best]]:
        """Each group once. With ``rows`` "emit", before its group every record as (the group's first row, best);
        with "pack" a group has the rows of its records, 8 bytes each.

        Records that come after the budget is reached still meet the table's entries; only new contents go to the
        spill files."""
        self.deepest = max(self.deepest, level)
        table, held = ContentTable(), 0
        files: list = []
        folder = None
        try:
            for code, best, size, content, payload in records:
                entry, new = table.find(code, content, held < self.budget)
                if entry < 0:
                    if not files:
                        folder = tempfile.mkdtemp(prefix="grace-", dir=self.folder)
                        files = [open(os.path.join(folder, f"{i}.bin"), "wb") for i in range(FAN_OUT)]
                    files[(code >> (4 * (15 - level % 16))) % FAN_OUT].write(_HEAD.pack(code, *best, size, len(content), len(payload)) + content + payload)
                    self.spilled += 1
                    continue
                if new:
                    held += len(content) + len(payload) + 250
                    table.payloads.append(payload)
                    table.best.append(best)
                    table.sizes.append(0)
                    table.firsts.append(best[-1])
                    table.rows.append(bytearray())
                table.sizes[entry] += size
                if best < table.best[entry]:
                    table.best[entry] = best
                    table.payloads[entry] = payload
                if rows == "pack":
                    held += 8
                    table.rows[entry] += best[-1].to_bytes(8, "little", signed=True)
                elif rows == "emit":
                    yield table.firsts[entry], best
            for f in files:
                f.close()
            yield from zip(table.best, table.sizes, table.firsts, table.contents, map(bytes, table.rows), table.payloads)
            del table
            for i in range(len(files)):
                path = os.path.join(folder, f"{i}.bin")
                yield from self.groups(_read(path), rows, level + 1)
                os.unlink(path)
        finally:
            for f in files:
                f.close()
            if folder:
                shutil.rmtree(folder, ignore_errors=True)


def _read(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            code, *best, size, n, m = _HEAD.unpack(head)
            yield code, tuple(best), size, f.read(n), f.read(m)


def _hash(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content)


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = MEMORY_BUDGET) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256."""
    ship_package(docs.sparkSession)
    integer_column(docs, key)
    rows = columns_of(docs, id=key, text=text).select(F.col("id").cast("bigint").alias("id"), "text").withColumn("row", F.monotonically_increasing_id())

    def local(batches):
        def records():
            for batch in batches_of(batches):
                for key_, text_, row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    content = text_.encode("utf-8", "surrogatepass").translate(None, WHITE)
                    yield _hash(content), best_of(len(text_), key_, row), 1, content, b""

        out = _Rows()
        for got in GraceDedup(budget).groups(records(), "emit"):
            if len(got) == 2:
                rep, (_, none, key_, _, row) = got
                yield from out.add(rep=rep, row=row, id=None if none else key_, best=None, length=None, size=None, code=None, content=None)
            else:
                (length, none, key_, _, row), size, rep, content, _, _ = got
                yield from out.add(rep=rep, row=None, id=None if none else key_, best=row, length=-length, size=size, code=_signed(_hash(content)), content=content)
        yield from out.flush()

    shape = "rep bigint, row bigint, id bigint, best bigint, length bigint, size bigint, code bigint, content binary"
    parts = stash(rows.mapInArrow(local, shape), "dedup-local")
    reps = parts.where("row is null").select("rep", "id", "best", "length", "size", "code", "content").repartition("code")

    def meet(batches):
        # A group's best row and its representatives are not the same rows: representatives go by number.
        def records():
            for batch in batches_of(batches):
                for rep, id_, row, length, size, code, content in zip(*(batch.column(i).to_pylist() for i in range(7))):
                    yield code & _MASK, best_of(length, id_, rep, row), size, content, b""

        columns: list[list] = [[], [], [], [], []]

        def batch_():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["rep", "keep_id", "keep_row", "group_size", "text_sha256"])

        for (_, none, keep, row, _), size, _, content, packed, _ in GraceDedup(budget).groups(records(), "pack"):
            digest = hashlib.sha256(content).hexdigest()
            for rep in memoryview(packed).cast("q"):
                for c, value in zip(columns, (rep, None if none else keep, row, size, digest)):
                    c.append(value)
                if len(columns[0]) == 20_000:
                    yield batch_()
                    for c in columns:
                        c.clear()
        yield batch_()

    verdicts = reps.mapInArrow(meet, "rep bigint, keep_id bigint, keep_row bigint, group_size bigint, text_sha256 string")
    members = parts.where("row is not null").select("rep", "row", "id")
    out = members.join(verdicts, "rep").select(
        F.col("id").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
    return out


_MASK = (1 << 64) - 1


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


class _Rows:
    """Collects rows into Arrow batches of about 4 MB."""

    SCHEMA = pa.schema([("rep", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("best", pa.int64()), ("length", pa.int64()), ("size", pa.int64()), ("code", pa.int64()), ("content", pa.binary())])

    def __init__(self) -> None:
        self.columns = {n: [] for n in self.SCHEMA.names}
        self.bytes = 0

    def add(self, **row):
        for n, x in row.items():
            self.columns[n].append(x)
        self.bytes += 60 + len(row["content"] or b"")
        if self.bytes > 4 << 20:
            yield from self.flush()

    def flush(self):
        if self.columns["rep"]:
            yield pa.RecordBatch.from_arrays([pa.array(self.columns[f.name], f.type) for f in self.SCHEMA], schema=self.SCHEMA)
        for x in self.columns.values():
            x.clear()
        self.bytes = 0


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = MEMORY_BUDGET) -> DataFrame:
    """The documents that stay, with all their columns; one shuffle, of each partition's distinct texts.

    Of rows that tie in length and id, the one whose values have the smallest hash stays, whatever the partitioning.
    """
    ship_package(docs.sparkSession)
    integer_column(docs, key)
    at_key, at_text, many = place(docs, key), place(docs, text), len(docs.columns)
    own = numbered(docs)
    coded = StructType([*own.schema.fields, StructField("code", LongType())])
    shape = to_arrow_schema(coded)

    def best(batches):
        def records():
            row = 0
            for batch in batches_of(batches):
                for values in zip(*(batch.column(i).to_pylist() for i in range(many))):
                    said = values[at_text] or ""
                    content = said.encode("utf-8", "surrogatepass").translate(None, WHITE)
                    payload = pickle.dumps(values, 5)
                    row += 1
                    yield _hash(content), best_of(len(said), values[at_key], row, _hash(payload)), 1, content, payload

        rows, size = [], 0

        def batch_():
            columns = list(zip(*rows)) if rows else [()] * (many + 1)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

        for _, _, _, content, _, payload in GraceDedup(budget).groups(records()):
            rows.append((*pickle.loads(payload), _signed(_hash(content))))
            size += len(payload)
            if size > 4 << 20:
                yield batch_()
                rows, size = [], 0
        yield batch_()

    local = own.mapInArrow(best, coded)
    return local.repartition("code").drop("code").mapInArrow(best, coded).drop("code").toDF(*docs.columns)
