"""Writing answers, evidence, runs, reports and indexes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators.evaluation import accuracy, answer_rows, compare_all, diagnostics, histogram, last_wins, pending
from gleanery.operators.segmentation import keep_first
from gleanery.sources.scratch import exists, materialise

_CST = timezone(timedelta(hours=8))


def write_tables(tables: dict[str, DataFrame], folder: str, by: str = "domain") -> None:
    """Parquet, a folder for each table, partitioned by ``by`` where a table has it."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(by) if by in df.columns else writer).parquet(f"{folder}/{name}")


def write_index(sections: DataFrame, units: DataFrame, cards: DataFrame, doc_cards: DataFrame, folder: str) -> None:
    """Cards as JSON lines and flat CSV files, a folder for each."""
    for name, df in (("sections", sections), ("units", units), ("field_cards", cards), ("doc_card", doc_cards)):
        df.write.mode("overwrite").json(f"{folder}/{name}")
    flat = lambda df: df.select(*(F.col(f.name) if f.dataType.simpleString() in ("string", "bigint", "int", "double", "boolean") else F.to_json(F.col(f.name)).alias(f.name) for f in df.schema.fields))
    for name, df in (("units", units), ("field_cards", cards)):
        flat(df).write.mode("overwrite").csv(f"{folder}/{name}_csv", header=True, encoding="UTF-8")


def report(units: DataFrame, sections: DataFrame, cards: DataFrame) -> dict[str, DataFrame]:
    """Counts by type, the first 40 sections, 30 cards."""
    return {
        "unit_types": histogram(units, "unit_type").orderBy(F.desc("n"), "unit_type"),
        "sections": sections.orderBy("doc_id", "start_ord").limit(40),
        "cards": cards.orderBy("doc_id", "ord").limit(30),
    }


def save_answers(results: DataFrame, path: str) -> None:
    """CSV of the summary row first, then answers by qid."""
    answer_rows(results).orderBy("place", "qid").drop("place").coalesce(1).write.mode("overwrite").csv(path, header=True)


def save_evidence(results: DataFrame, path: str) -> None:
    """JSON lines of answer, evidence and raw answer (or reasoning)."""
    raw = F.coalesce(F.nullif("raw_answer", F.lit("")), F.col("reasoning")) if "reasoning" in results.columns else F.col("raw_answer")
    results.select("qid", "answer", "evidence", raw.alias("raw_answer")).write.mode("overwrite").json(path)


def append_results(results: DataFrame, path: str) -> None:
    """Partial results and detail logs: appended, never rewritten."""
    results.write.mode("append").parquet(path)


def resume(wanted: DataFrame, path: str) -> DataFrame:
    """What a results folder doesn't hold yet; everything if it isn't there."""
    spark = wanted.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return wanted
    return pending(wanted, spark.read.parquet(path).select("qid").distinct())


@dataclass
class Run:
    """A run's manifest; ``finish`` or ``fail`` closes it."""

    coder: str
    method_id: str
    config: dict
    run_id: str = ""
    status: str = "running"
    started_at: str = ""
    finished_at: str | None = None
    metrics: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        now = datetime.now(_CST)
        self.started_at = self.started_at or now.isoformat()
        self.run_id = self.run_id or f"{now:%Y%m%d_%H%M%S}_{self.coder}_{self.method_id}"

    @property
    def config_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]

    def finish(self, **metrics: float) -> "Run":
        self.status, self.finished_at = "success", datetime.now(_CST).isoformat()
        self.metrics |= metrics
        return self

    def fail(self, error: str) -> "Run":
        self.status, self.finished_at, self.metrics = "failed", datetime.now(_CST).isoformat(), {"error": error}
        return self

    def write(self, spark: SparkSession, folder: str) -> None:
        row = {k: v for k, v in self.__dict__.items() if k not in ("config", "metrics")} | {"config_hash": self.config_hash, "metrics": json.dumps(self.metrics)}
        shape = "coder string, method_id string, run_id string, status string, started_at string, finished_at string, config_hash string, metrics string"
        spark.createDataFrame([row], shape).write.mode("append").json(f"{folder}/runs")


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    return last_wins([old, new], "doc_id")


def pages_to_render(stubs: DataFrame, fields: DataFrame, most: int = 60) -> DataFrame:
    """Pages (doc_id, page) to look at: those without text first, then those with fields; each once."""
    rows = stubs.select("doc_id", "page", F.lit(0).alias("priority")).union(fields.select("doc_id", "page", F.lit(1).alias("priority")))
    once = keep_first(rows, ["doc_id", "page"], "priority")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("priority", "page"))
    return once.withColumn("place", n.cast("bigint")).where(F.col("place") <= most)


def build_statistics(builds: DataFrame) -> DataFrame:
    """Builds (doc_id, status) as counts of success, skipped and failed."""
    return builds.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("success", "skipped", "failed")), F.count("*").alias("total"))


def write_diagnostics(items: DataFrame, folder: str) -> None:
    """Retrieval diagnostics of a run as JSON lines: ``questions`` and ``summary``."""
    for name, df in zip(("questions", "summary"), diagnostics(items)):
        df.write.mode("overwrite").json(f"{folder}/{name}")


def write_comparison(results: DataFrame, gold: DataFrame, folder: str) -> None:
    """Answers beside gold answers as JSON lines and CSV, and accuracy by domain."""
    rows = compare_all(results, gold)
    rows.write.mode("overwrite").json(f"{folder}/comparison_json")
    rows.select("qid", "domain", "answer", "gold", "correct").write.mode("overwrite").csv(f"{folder}/comparison_csv", header=True)
    accuracy(rows.where("correct is not null"), "domain").write.mode("overwrite").json(f"{folder}/accuracy")


def build_cache(wanted: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, force: bool = False) -> DataFrame:
    """Documents (doc_id, domain) that ``build`` turns into blocks (doc_id, ..., text), appended to the cache under
    ``folder``; those already there are skipped unless ``force``. Gives (doc_id, status) and upserts the manifest.

    Documents without any block count as failed and aren't cached, so the next run tries them again.
    """
    spark = wanted.sparkSession
    names = ["doc_id", "domain"]
    blocks_at, manifest_at = f"{folder}/blocks", f"{folder}/manifest"
    there = exists(spark, manifest_at)
    done = spark.read.parquet(manifest_at).select("doc_id") if there else wanted.select("doc_id").limit(0)
    todo = wanted.select(*names) if force else wanted.select(*names).join(done, "doc_id", "left_anti")
    made = materialise(build(todo), "built-blocks")
    got = made.select("doc_id").distinct()
    writer = made.join(wanted.select(*names), "doc_id").write.partitionBy("domain", "doc_id").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").parquet(blocks_at)
    built = todo.select("doc_id").join(got.withColumn("ok", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("ok"), "success").otherwise("failed").alias("status"))
    skipped = wanted.select("doc_id").join(todo.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("skipped").alias("status"))
    status = materialise(built.unionByName(skipped), "build-status")
    new = wanted.select(*names).join(status.where("status = 'success'").select("doc_id"), "doc_id", "left_semi")
    manifest = upsert_manifest(spark.read.parquet(manifest_at), new) if there else new
    materialise(manifest, "manifest").write.mode("overwrite").parquet(manifest_at)
    return status
