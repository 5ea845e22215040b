"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it.
Fingerprints are linked when at most ``distance`` bits differ. They are cut into
``distance + 3`` blocks; two linked fingerprints agree on at least three whole blocks, so
joining on every choice of three blocks finds them all. Only distinct fingerprints are
joined (copies are grouped first), the values that share a choice of blocks stream through
one task in sorted order, and what leaves is not every pair but a spanning forest of the
verified links: at most one row per value.

A group of more than ``DIRECT`` values isn't compared there. Its values are dealt again: the
bits that the choice leaves free are cut into blocks in the same way, two of four of which any
two linked values share, so groups get a finer key (50 bits or more of 64 are fixed, 2^14
values at most remain) and no pair is lost. Every link, in either step, is a pair whose
Hamming distance was counted. A task holds one group of at most 2^14 values.

Defined results: null text is empty; texts are read whole, however long; texts without words
have fingerprint zero and are linked like any other; repeated rows have equal fingerprints
and so are linked; an id that repeats with other texts links nothing by itself; empty tables
give no rows; other columns are ignored, whatever they are called. Ids are of any type with
an order; rows with a null id get the smallest id of their component's other rows, or null if
there is none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.components import components
from gleanery.llm.shared import batches_of, columns_of, numbered, place, stash
from gleanery.session import ship_package

SEED = 42
WIDTH = 3
DISTANCE = 2
#: Groups up to this size compare all their values; larger ones are dealt again by further bits.
DIRECT = 1500
#: A fingerprint of more rows than this is told its component by a broadcast: there can't be many such.
HOT_ROWS = 1 << 20
MOST_BROADCAST = 100_000


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """XXH64 of every shingle, repeats included; the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # lower: A-Z only; split: ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = (np.cumsum(sizes + 1) - sizes - 1).tolist()
    ends = (np.cumsum(sizes + 1) - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, fp bigint): fp is the fingerprint as a signed 64-bit integer."""
    ship_package(docs.sparkSession)
    kind = docs.schema.fields[place(docs, key)].dataType.simpleString()

    def run(batches):
        for batch in batches_of(batches):
            got = np.array([fingerprint(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["key", "fp"])

    return columns_of(docs, key=key, text=text).mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def block_masks(distance: int = DISTANCE, agree: int = 3, bits: list[int] | None = None) -> list[int]:
    """Bit masks of every choice of ``agree`` blocks out of ``distance + agree``, cut from ``bits`` (all 64)."""
    bits = list(range(64)) if bits is None else bits
    n = distance + agree
    edges = [len(bits) * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, agree)]


def finer_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """``mask`` with each choice of two of the blocks that its free bits are cut into."""
    return [mask | m for m in block_masks(distance, 2, [b for b in range(64) if not mask >> b & 1])]


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_group(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest (pairs of places) of the values at most ``distance`` bits apart: every value is compared
    with those after it."""
    parent = list(range(len(values)))
    out = []
    for i in range(len(values) - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance)
        for j in near.tolist():
            a, b = _find(parent, i), _find(parent, i + 1 + j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, i + 1 + j))
    return out


def _keyed(nodes: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """Nodes (fp, node) once per mask (number, bits), dealt and sorted by what the mask leaves of fp."""
    parts = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in masks))
    rows = nodes.select("fp", "node", F.explode(parts).alias("k")).select("k.choice", "k.part", "fp", "node")
    return rows.repartition("choice", "part").sortWithinPartitions("choice", "part", "fp")


def _link_groups(dealt: DataFrame, distance: int, most: int | None) -> DataFrame:
    """(a, b) links within groups of equal (choice, part); of a group with more than ``most`` values rows
    (choice, a: fp, b: node) leave instead, as they come. A link's choice is -1."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last, size = None, 0
        out: list[tuple[int, np.ndarray, np.ndarray]] = []

        def table():
            choice = np.concatenate([np.full(len(a), c, np.int32) for c, a, _ in out] or [np.zeros(0, np.int32)])
            a, b = (np.concatenate([x[i] for x in out] or [np.zeros(0, np.int64)]) for i in (1, 2))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(choice), pa.array(a), pa.array(b)], ["choice", "a", "b"])

        def defer():
            out.extend((last[0], values.view(np.int64), ids) for values, ids in held)
            held.clear()

        def close():
            if most is not None and size > most:
                defer()
            elif size > 1:
                values, ids = (np.concatenate(x) for x in zip(*held))
                pairs = np.array(link_group(values, distance), np.int64).reshape(-1, 2)
                if len(pairs):
                    out.append((-1, ids[pairs[:, 0]], ids[pairs[:, 1]]))

        for batch in batches:
            choice, part, fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            n = len(fp)
            if not n:
                continue
            starts = np.concatenate(([0], np.flatnonzero((choice[1:] != choice[:-1]) | (part[1:] != part[:-1])) + 1))
            ends = np.append(starts[1:], n)
            fp = fp.view(np.uint64)
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                # Groups of one row inside the batch have nothing to link.
                if 0 < k < len(starts) - 1 and b - a == 1:
                    continue
                own = (int(choice[a]), int(part[a]))
                if own != last:
                    close()
                    held, last, size = [], own, 0
                held.append((fp[a:b].copy(), node[a:b].copy()))
                size += b - a
                if most is not None and size > most:
                    defer()
            yield table()
        close()
        yield table()

    return dealt.mapInArrow(run, "choice int, a bigint, b bigint")


def links(nodes: DataFrame, distance: int = DISTANCE, direct: int = DIRECT) -> DataFrame:
    """(a, b): links between nodes (fp, node) of distinct fp, enough to connect all that are close."""
    ship_package(nodes.sparkSession)
    masks = block_masks(distance)
    first = stash(_link_groups(_keyed(nodes, list(enumerate(masks))), distance, direct), "links")
    finer = list(enumerate(m for mask in masks for m in finer_masks(mask, distance)))
    many = len(finer) // len(masks)
    later = first.where("choice >= 0").select(F.col("a").alias("fp"), F.col("b").alias("node"), "choice")
    # A deferred value goes to the finer masks of its own choice only.
    parts = F.array(*(F.struct(F.lit(i).alias("fine"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in finer))
    again = later.select("fp", "node", F.explode(F.slice(parts, F.col("choice") * many + 1, many)).alias("k")).select(F.col("k.fine").alias("choice"), "k.part", "fp", "node")
    second = _link_groups(again.repartition("choice", "part").sortWithinPartitions("choice", "part", "fp"), distance, None)
    return first.where("choice < 0").select("a", "b").union(second.select("a", "b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One row per document: key, fp, component_id (the smallest key that can be reached)."""
    prints = stash(fingerprints(docs, key, text, width), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min(key).alias("node"), F.count("*").alias("n")), "distinct-fingerprints")
    edges = links(nodes.select("fp", F.col("fp").alias("node")), distance)
    roots = components(edges)  # between fingerprints
    named = nodes.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "node", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("node").alias("component_id"))
    verdict = named.join(least, "root").select("fp", "component_id", "n")
    hot = nodes.where(F.col("n") > HOT_ROWS).select("fp")
    most = hot.limit(MOST_BROADCAST + 1).count()
    if not 0 < most <= MOST_BROADCAST:  # none, or too many to broadcast: then adaptive execution splits them
        return prints.join(verdict.drop("n"), "fp").select(key, "fp", "component_id")
    told = F.broadcast(verdict.where(F.col("n") > HOT_ROWS).drop("n"))
    rest = prints.join(F.broadcast(hot), "fp", "left_anti").join(verdict.where(F.col("n") <= HOT_ROWS).drop("n"), "fp")
    return prints.join(told, "fp").select(key, "fp", "component_id").unionByName(rest.select(key, "fp", "component_id"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """The columns of query ``op7_simhash_dedup``."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose id is their component's smallest, with all their columns.

    Rows that share an id stay or go together; rows without an id can't be told apart and all stay.
    """
    own, at = numbered(docs), f"c{place(docs, key)}"
    plain = own.select(F.col(at).alias("key"), F.col(f"c{place(docs, text)}").alias("text"))
    stays = near_duplicates(plain, "key", "text").where("component_id is not null").select(F.col("component_id").alias("stays")).distinct()
    return own.join(stays, F.col(at) == F.col("stays"), "left_semi").unionByName(own.where(F.col(at).isNull())).toDF(*docs.columns)
