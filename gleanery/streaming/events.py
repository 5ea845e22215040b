"""Streaming: answering questions as files arrive, and window aggregates over events.

The reference method has no streams; these are extensions. The same functions work on
batches, which is how their results are checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.sources.files import QUESTION
from gleanery.sources.sinks import append_results, resume


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type, value) per hour and type; on streams, later ones than ``late`` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A user's sessions: events with no longer pause than ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))


def answer_stream(spark: SparkSession, folder: str, answer: Callable[[DataFrame], DataFrame], results: str, checkpoint: str) -> StreamingQuery:
    """Question files (JSON lines) that arrive in ``folder`` are answered once each and appended to ``results``.

    A batch that is run again after a failure answers only what isn't in the results yet.
    """
    def batch(questions: DataFrame, _: int) -> None:
        append_results(answer(resume(questions.dropDuplicates(["qid"]), results)), results)

    stream = spark.readStream.schema(QUESTION).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
