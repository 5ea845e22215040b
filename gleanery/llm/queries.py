"""Registered queries of the corpus operators and their SQL, keyed as in ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import bestfit_packing, chat_format, exact_dedup, html_extract, license_scan, quality_rules, secret_scan, simhash_dedup, source_mixing, sql, sstable
from gleanery.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_report(table(spark, sf_dir, "conversations"))


def op6_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.shard_report(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.fingerprint_report(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixing_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    made = (
        op1_license_scan, op2_secret_scan, op3_exact_dedup, op4_quality_rules, op5_chat_format,
        op6_sstable_shards, op7_simhash_dedup, op8_html_extract, op9_bestfit_packing, op10_source_mixing,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL form (hash functions, trained models, tokens); tests compare them with brute force."""
    # The SQL is as it was given: logins of up to 64 characters, where the operator has no bound.
    bounded = {"url_login": r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"}
    rules = [(r.kind, bounded.get(r.kind, r.pattern), r.group, r.least) for r in secret_scan.RULES]
    op1 = sql.op1(license_scan.trained_model(), license_scan.templates(), license_scan.WORD, license_scan.CONFIRM, license_scan.UNIT)
    return {"op1_license_scan": op1, "op2_secret_scan": sql.op2(rules, len(secret_scan.BASE_RULES)), "op3_exact_dedup": sql.OP3, "op5_chat_format": sql.OP5, "op8_html_extract": sql.OP8, "op10_source_mixing": sql.OP10}
