"""Connected components of a graph held in DataFrames, by alternating large and small stars.

Each round makes every node point to smaller neighbours only; the number of rounds grows
with the logarithm of the longest path. Edges always point from the larger node a to the
smaller node b, and everything is keyed by the larger one: a hub, the smallest of many, is
never a key, as it has no smaller neighbour that others would have to be told of. Minima are
taken in two steps, by (a, part of b) first, so that a node with very many smaller
neighbours spreads too. Rounds are cut off from each other by tables in the shared folder,
which are removed as soon as they are read; nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import drop_path, scratch_path

#: Parts over which one node's neighbours are spread before their minimum is taken.
PARTS = 64


def _least(edges: DataFrame) -> DataFrame:
    """(n, m): every node with smaller neighbours and the smallest of these."""
    part = F.pmod(F.xxhash64("b"), F.lit(PARTS))
    some = edges.groupBy("a", part.alias("part")).agg(F.min("b").alias("m"))
    return some.groupBy(F.col("a").alias("n")).agg(F.min("m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    # Large star: a larger neighbour of b points to b's smallest neighbour instead, if b has a smaller one.
    least = _least(edges)
    up = edges.join(least, F.col("b") == F.col("n"), "left").select("a", F.coalesce("m", "b").alias("b"))
    # Small star: the smaller neighbours of a, and a, point to the smallest of them.
    least = _least(up)
    moved = up.join(least, F.col("a") == F.col("n")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b): every node that has an edge and isn't its component's smallest, with that smallest node.

    ``edges`` has integer columns a and b; loops and repeated edges are allowed, nulls are not.
    """
    spark = edges.sparkSession
    path, mark = None, None
    current = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(most_rounds):
        stars = _round(current)
        new = scratch_path(spark, "stars")
        stars.write.parquet(new)
        current = spark.read.schema(stars.schema).parquet(new)
        if path:
            drop_path(spark, path)
        path = new
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            return current
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
