"""Benchmark items dealt to documents."""

import shutil

from gleanery.plans import all_queries
from gleanery.plans import inputs as I


def test_every_item_is_used(spark):
    docs = spark.range(200).withColumnRenamed("id", "doc_id")
    items = spark.createDataFrame([(i, f"item {i}") for i in range(90)], "item_id bigint, text string")
    got = {r["doc_id"]: r["query"] for r in I.with_items(docs, items).collect()}
    assert got == {i: f"item {i % 90}" for i in range(200)}
    gaps = {r["doc_id"]: r["query"] for r in I.with_items(docs, items.where("item_id % 3 > 0")).collect()}
    assert len(gaps) == 200 and set(gaps.values()) == {f"item {i}" for i in range(90) if i % 3}
    assert I.with_items(docs, items.limit(0)).count() == 0


def test_items_beyond_the_smallest_table(spark, sf, tmp_path):
    # Every document is an item too: paired with itself, it holds all of its own terms.
    shutil.copy(f"{sf}/documents.parquet", tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.selectExpr("doc_id AS item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = all_queries.QUERIES["proxy_coverage"](spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() and all(r["coverage"] in (0, 1) and r["numeric_ok"] for r in rows)
    assert all_queries.QUERIES["hybrid_score"](spark, str(tmp_path)).count() == I.units(spark, str(tmp_path)).count()
