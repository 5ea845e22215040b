"""Whole methods with a deterministic model, relational parity, and the streaming extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.vocab import LATIN
from gleanery.operators.retrieval import add_scores
from gleanery.plans import inputs as I
from gleanery.plans.methods import METHODS, answer_questions, claim_workflow
from gleanery.plans.models import StubModel
from gleanery.plans.registry import query
from gleanery.session import table


def asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as questions over the lines of the documents."""
    kind = F.when(F.col("qid") % 3 == 0, "multi").when(F.col("qid") % 3 == 1, "mcq").otherwise("tf")
    questions = I.questions(spark, d).select(F.concat(F.lit("res_"), "qid").alias("qid"), "question", "options", kind.alias("answer_format"), F.array().cast("array<bigint>").alias("doc_ids"), F.lit("research").alias("domain"))
    return questions, I.units(spark, d)


@query()
def method_stem_and_options(spark: SparkSession, d: str) -> DataFrame:
    """The stem-and-options method with a stub model."""
    return answer_questions(*asked(spark, d), METHODS["m05"], StubModel(), LATIN).drop("evidence")


@query()
def method_voting(spark: SparkSession, d: str) -> DataFrame:
    return answer_questions(*asked(spark, d), METHODS["m02"], StubModel(1), LATIN).drop("evidence")


@query()
def claim_workflow_stub(spark: SparkSession, d: str) -> DataFrame:
    return claim_workflow(*asked(spark, d), METHODS["m06"], StubModel(), vocabulary=LATIN)


@query("""SELECT n_name, CAST(count(*) AS BIGINT) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Relational parity: four joins and an aggregate."""
    t = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem", "supplier", "nation")}
    rows = t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey")).join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())""")
def totals_and_detail(spark: SparkSession, d: str) -> DataFrame:
    aggs = (F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n"))
    return table(spark, d, "lineitem").groupingSets([["l_returnflag", "l_linestatus"], []], "l_returnflag", "l_linestatus").agg(*aggs)


@query("SELECT user_id AS qid, event_type AS id, round(sum(value), 4) AS score FROM events GROUP BY user_id, event_type")
def score_accumulation(spark: SparkSession, d: str) -> DataFrame:
    return add_scores(table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("id"), F.col("value").alias("score")), ["qid", "id"])


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def extension_hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: what the streaming window aggregate gives once all events are in."""
    from gleanery.streaming.events import hourly

    return hourly(table(spark, d, "events")).select(F.col("window.start").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))


@query()
def section_router(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in the order of a stub model that names sections 2 and 1 of every question's list."""
    from gleanery.functions.vocab import LATIN
    from gleanery.plans.methods import route_sections

    questions, units = asked(spark, d)
    return route_sections(questions, units, I.sections(units), LATIN, lambda prompt: ("<<<2>>> <<<1>>>", 1, 1))
