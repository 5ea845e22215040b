"""Comparison with gold answers, proxy recall, token cost and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Inner join on qid of (qid, answer) tables: (qid, answer, gold, correct)."""
    return predicted.join(gold.select("qid", F.col("answer").alias("gold")), "qid").withColumn("correct", F.col("answer") == F.col("gold"))


def accuracy(compared: DataFrame, *by: str) -> DataFrame:
    """By group and overall (group null): n, right, accuracy; 0 where there is none."""
    right = F.count_if("correct")
    rows = compared.rollup(*by) if by else compared.groupBy()
    return rows.agg(F.count("*").alias("n"), right.alias("n_right"), F.round(F.coalesce(F.try_divide(right, F.count("*")), F.lit(0.0)), 4).alias("accuracy"))


def rates(hits: DataFrame, by: str, hit: Column) -> DataFrame:
    """Rate of hits by group and overall."""
    return hits.rollup(by).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_hit"), F.round(F.count_if(hit) / F.count("*"), 4).alias("rate"))


def run_summary(results: DataFrame, budget: int) -> DataFrame:
    """Totals of (prompt_tokens, completion_tokens), token score and final multiplier, in one row."""
    total = F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    row = results.agg(F.count("*").alias("n"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"), F.coalesce(total, F.lit(0)).alias("total_tokens"))
    score = F.when(F.col("total_tokens") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (budget - F.col("total_tokens")) / budget)))
    return row.withColumn("token_score", F.round(score, 6)).withColumn("multiplier", F.round(0.7 + 0.3 * score, 6))


def domain_stats(results: DataFrame, domain: str, tokens: str) -> DataFrame:
    """Per domain: number, tokens, whole-number average."""
    return results.groupBy(domain).agg(F.count("*").alias("n"), F.sum(F.coalesce(tokens, F.lit(0))).alias("tokens"), F.expr(f"sum(coalesce({tokens}, 0)) div count(*)").alias("average"))


def answer_rows(results: DataFrame) -> DataFrame:
    """The answer file's rows in order: a summary of token totals (place 0), then each qid (place 1, by qid)."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    sums = results.agg(*(F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names)).select(F.lit("summary").alias("qid"), F.lit("").alias("answer"), *names, F.lit(0).cast("bigint").alias("place"))
    return sums.unionByName(results.select("qid", "answer", *names).withColumn("place", F.lit(1).cast("bigint")))


def last_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in which a later table's row replaces an earlier one's with the same key."""
    union = None
    for i, part in enumerate(parts):
        own = part.withColumn("__source", F.lit(i))
        union = own if union is None else union.unionByName(own, allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__source")))
    return union.withColumn("__n", n).where("__n = 1").drop("__n", "__source")


def pending(wanted: DataFrame, done: DataFrame, key: str = "qid") -> DataFrame:
    """What has no result yet."""
    return wanted.join(done, key, "left_anti")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def item_hits(items: DataFrame) -> DataFrame:
    """Ranked items (qid, rank, hit): number of hits and the first one's rank (0 without any)."""
    return items.groupBy("qid").agg(F.count_if("hit").alias("n_hit"), F.coalesce(F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0)).cast("bigint").alias("first_hit"))


def compare_all(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Left join on qid: (qid, answer, gold, correct); correct is null where there is no gold, so it counts nowhere."""
    return results.join(gold.select("qid", F.col("answer").alias("gold")), "qid", "left").withColumn("correct", F.col("answer") == F.col("gold"))


def hit_rates(ranks: DataFrame, by: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Questions (by, first: rank of the first right item, 0 for none) as the share hit within each k, by group and overall."""
    shares = (F.round(F.count_if((F.col("first") > 0) & (F.col("first") <= k)) / F.count("*"), 4).alias(f"hit_{k}") for k in ks)
    return ranks.rollup(by).agg(F.count("*").alias("n"), *shares)


def mean_confidence(answers: DataFrame, by: str, order: str) -> DataFrame:
    """Answers with the mean confidence of those so far, in order, per group."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return answers.withColumn("mean_confidence", F.avg("confidence").over(so_far))


def diagnostics(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked items (qid, domain, rank, score, hit) as a row per question and a summary by domain and overall."""
    per = items.groupBy("qid", "domain").agg(F.count("*").alias("n_items"), F.count_if("hit").alias("n_hit"), F.coalesce(F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0)).cast("bigint").alias("first"), F.round(F.max("score"), 4).alias("best"))
    summary = per.rollup("domain").agg(F.count("*").alias("n"), F.sum("n_items").alias("n_items"), F.count_if(F.col("first") > 0).alias("n_with_hit"), F.round(F.avg("best"), 4).alias("mean_best"))
    return per, summary
