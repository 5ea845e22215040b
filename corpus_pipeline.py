"""Corpus preparation: quality rules, exact and near duplicates, mixing, packing.

Each stage is (name, function(spark, docs, sf_dir) -> DataFrame). Its result is written as
Parquet and read again as the next stage's ``docs``; all but the last return the columns of
``documents``, further ones included, whatever they are called. Every stage works on all rows
that it is given. What odd rows come to:

* null and empty texts fail the base rules of the first stage; a stage that is given some all
  the same keeps one (exact duplicates), links them with each other (near duplicates), takes
  them as often as others of their source (mixing: they add no words; of a source without any
  word nothing is taken), and packs one end token each (packing);
* rows that repeat as a whole, or differ in white space only, leave one row: the longest, then
  the smallest id, then by a hash of the row;
* rows without an id are never near duplicates of each other, as they can't be told apart;
* ties are settled by ids and hashes, so that results don't depend on the partitioning;
* texts of any length are read whole; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import table
from gleanery.sources import scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (4). The model is fitted on these documents and the labels."""
    from gleanery.llm import quality_rules

    return quality_rules.filter_documents(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (3): the longest, then the smallest id."""
    from gleanery.llm import exact_dedup

    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints (7): the smallest id."""
    from gleanery.llm import simhash_dedup

    return simhash_dedup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (10)."""
    from gleanery.llm import source_mixing

    return source_mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies (9); a document taken twice is packed twice."""
    from gleanery.llm import bestfit_packing

    return bestfit_packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bestfit_packing", pack),
]

#: Fingerprints, fitted models and tokenization have no SQL form; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next begins.

    What a stage wrote for itself, and the table it was given, are removed once its result is there.
    """
    docs, given = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        start = scratch.mark()
        out = stage(spark, docs, sf_dir)
        path = scratch.scratch_path(spark, f"stage-{name}")
        out.write.parquet(path)
        scratch.drop_since(start, path)
        if given:
            scratch.drop_path(spark, given)
        docs, given = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
