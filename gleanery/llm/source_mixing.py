"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size
(never above ``most_copies``). In a fixed order within its source, the expected copies are
summed up; one random offset per source is added, and a document is emitted once for each
integer boundary that its stretch of the sum crosses. So it gets floor or ceil of its
expectation, and as documents are ordered by size, every range of sizes gets its share and
the words taken come near the target.

Expectations are integers (units of 2^-24 copies), so sums are exact, and any partitioning
gives the same result. The prefix sum is distributed: rows are dealt by ranges of (source,
size, id, hash of the row), each range's rows are counted, and offsets are added; a source
that holds a third of all rows spreads over many ranges.

Targets are shared out without a loop: sources are put in the order of the level at which they
reach their cap, and with prefix sums in that order the first one that stays below its cap
tells what all the others after it get. Sources stay in tables (there may be as many as there
are web sites); two numbers and that one source reach the driver.

Defined results: null text has size 0; texts are read whole, however long; a null source is a
source of its own, last in order; sources without words have target 0 and take nothing; rows
that tie in source, size and id are put in order by a hash of all their columns, so that what
is taken doesn't depend on the partitioning (rows alike in all columns are interchangeable);
empty tables give no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.shared import numbered, place, stash, text_of

#: A source's weight goes by its place in order: first, second, third, and again.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a multiple of all words.
TOTAL = 1.5
MOST_COPIES = 2
UNIT = 1 << 24
SEED = 42
MOST_BROADCAST = 100_000


def sizes(docs: DataFrame, text: str = "text") -> F.Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def water_fill(total: float, weights: list[float], caps: list[float]) -> list[float]:
    """Shares of ``total`` by weight, none above its cap; what a cap cuts off is shared again by weight.

    The plain loop over rounds, which tests hold :func:`targets` against.
    """
    out = [0.0] * len(caps)
    open_ = list(range(len(caps)))
    left = total
    while open_:
        by = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / by > caps[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / by
            break
        for i in over:
            out[i] = float(caps[i])
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def offset(source: str | None, seed: int = SEED) -> int:
    """The source's random offset, in units, from 0 to UNIT - 1."""
    said = f"{seed}:{'null' if source is None else 'source ' + source}"
    return int.from_bytes(hashlib.sha256(said.encode()).digest()[:8], "big") % UNIT


def running(rows: DataFrame, order: list[F.Column], **sums: str) -> DataFrame:
    """``rows`` with further columns: the sum of an integer column over all rows before this one in the given order.

    Rows are dealt by ranges; only one row per range goes through a window without partitions.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    held = stash(ranged, "running").withColumn("part", F.shiftright("pos", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = held.groupBy("part").agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    starts = per.select(F.col("part").alias("of"), *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"{name}_start") for name in sums))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    joined = held.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{name}_inside") for name, c in sums.items())).join(starts, F.col("part") == F.col("of"))
    return joined.select(*rows.columns, *((F.col(f"{name}_start") + F.col(f"{name}_inside")).alias(name) for name in sums))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """For sources (src, source_size): src, source_size, target, each (expected copies in units), offset (in units)."""
    named = totals.select("src", F.col("source_size").cast("bigint").alias("source_size"), F.lit(1).cast("bigint").alias("one"))
    placed = running(named, [F.col("src").asc_nulls_last()], place="one")
    chosen = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1).cast("bigint")
    weighed = placed.select("src", "source_size", chosen.alias("w"), (F.lit(most) * F.col("source_size")).alias("cap"))
    level = [F.col("source_size") / F.col("w").cast("double"), F.col("src").asc_nulls_last()]
    levels = running(weighed, level, caps="cap", ws="w")
    words, all_w = levels.agg(F.sum("source_size"), F.sum("w")).first()
    left = F.lit(float(total)) * F.lit(words or 0) - F.col("caps")
    by = F.lit(all_w or 0) - F.col("ws")
    shared = levels.withColumn("left", left).withColumn("by", by)
    cut = shared.where(F.col("left") * F.col("w") / F.col("by") <= F.col("cap")).orderBy(*level).select("left", "by").first()
    share = F.lit(cut[0]) * F.col("w") / F.lit(cut[1]) if cut else F.lit(float("inf"))
    target = F.least(share, F.col("cap").cast("double"))
    said = F.concat(F.lit(f"{seed}:"), F.when(F.col("src").isNull(), "null").otherwise(F.concat(F.lit("source "), F.col("src").cast("string"))))
    # The last 24 of the digest's first 64 bits.
    start = F.conv(F.substring(F.sha2(said, 256), 11, 6), 16, 10).cast("bigint")
    each = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.lit(most * UNIT), F.round(F.col("target") / F.col("source_size") * UNIT))).cast("bigint")
    return levels.withColumn("target", target).select("src", "source_size", "target", each.alias("each"), start.alias("offset"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, seed: int = SEED, carry: bool = False) -> DataFrame:
    """One row per document: key, source, size, source_size, target, copies, taken.

    With ``carry`` the document's own columns stand in a struct ``row`` as c0, c1, ...
    """
    own = numbered(docs)
    at = {name: f"c{place(docs, name)}" for name in (key, source, text)}
    tie = F.xxhash64(*(f.name for f in own.schema.fields if "map<" not in f.dataType.simpleString()))
    columns = [F.col(at[key]).alias("key"), F.col(at[source]).alias("src"), sizes(own, at[text]).alias("size"), tie.alias("tie")]
    if carry:
        columns.append(F.struct(*own.columns).alias("row"))
    # Ranges are drawn once: the table fixes which row is in which range, and where. In a sorted range the
    # identifier counts rows, so no window is needed and the documents are shuffled only here.
    order = (F.col("src").asc_nulls_last(), F.col("size"), F.col("key"), F.col("tie"))
    ranged = own.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    placed = stash(ranged.withColumn("pos", F.monotonically_increasing_id()), "mixing").withColumn("part", F.shiftright("pos", 33))
    per = placed.groupBy("src", "part").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.sum("size").alias("words"))
    plan = targets(per.groupBy("src").agg(F.sum("words").alias("source_size")), weights, total, seed=seed).withColumnRenamed("src", "of")
    # Rows before each range, within its source: a window over ranges, not over documents.
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(F.col("src").alias("r_src"), F.col("part").alias("r_part"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts = stash(starts.join(plan, F.col("r_src").eqNullSafe(F.col("of"))).drop("of"), "mixing-ranges")
    # One row per range and source in it. Few are broadcast; beyond MOST_BROADCAST rows (some 100 bytes each) they are not.
    if starts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    joined = placed.join(starts, (F.col("part") == F.col("r_part")) & F.col("src").eqNullSafe(F.col("r_src"))).withColumn("rank", F.col("pos") - F.col("first") + 1)
    copies = F.expr(f"((offset + (before + rank) * each) div {UNIT}) - ((offset + (before + rank - 1) * each) div {UNIT})")
    return joined.select(
        F.col("key").alias(key), F.col("src").alias("source"), "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), *(["row"] if carry else []),
    )


def mixing_report(docs: DataFrame) -> DataFrame:
    """The columns of query ``op10_source_mixing``."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def take(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    mixed = mix(docs, key, source, text, carry=True).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*").toDF(*docs.columns)
