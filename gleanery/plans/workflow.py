"""Retrievers and the question workflow as classes whose steps can be replaced.

Every hook takes and gives DataFrames or Columns, so whatever replaces one stays part of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.vocab import CHINESE, Vocabulary
from gleanery.operators import bm25, claims, retrieval, scoring, search
from gleanery.operators import segmentation as S
from gleanery.plans.methods import METHODS, Method, answer_questions


class Retriever(Protocol):
    """Finds evidence for questions, and puts several results together."""

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """(qid, label, unit_id, doc_id, score)"""

    def merge(self, found: DataFrame) -> DataFrame:
        """(qid, evidence_id, score, labels)"""


@dataclass
class RetrieverBase:
    """The steps of a retrieval in order; each is a method to override. ``run_search`` is the one that must be."""

    units: DataFrame
    vocabulary: Vocabulary = CHINESE
    stem_k: int = 10
    option_k: int = 10
    bonus: float = 1.25

    def warmup(self) -> "RetrieverBase":
        """Whatever should be ready before the first question."""
        return self

    def plan_query(self, questions: DataFrame) -> DataFrame:
        return questions

    def resolve_targets(self, questions: DataFrame) -> DataFrame:
        """(qid, doc_id) of the documents to look in; a question without any looks in all."""
        return questions.select("qid", F.explode("doc_ids").alias("doc_id"))

    def build_subqueries(self, questions: DataFrame) -> DataFrame:
        return S.option_queries(questions, self.stem_k, self.option_k)

    def run_search(self, subqueries: DataFrame, targets: DataFrame) -> DataFrame:
        """(qid, label, unit_id, doc_id, score)"""
        raise NotImplementedError(f"{type(self).__name__} must say how it searches")

    def postprocess_items(self, found: DataFrame) -> DataFrame:
        return found

    def compute_evidence_id(self) -> Column:
        return T.evidence_id(F.col("doc_id").cast("string"), F.col("unit_id"), otherwise=F.col("unit_id"))

    def render_content(self) -> Column:
        return T.render_fields([("doc", F.col("doc_id")), ("section", F.col("section_id")), ("text", F.col("text"))])

    def merge_score(self, found: DataFrame) -> DataFrame:
        return retrieval.merge_hits(found, ["qid", "evidence_id", "unit_id", "doc_id"], self.bonus)

    def retrieve(self, questions: DataFrame) -> DataFrame:
        planned = self.plan_query(questions)
        found = self.run_search(self.build_subqueries(planned), self.resolve_targets(planned))
        return self.postprocess_items(found).withColumn("evidence_id", self.compute_evidence_id())

    def merge(self, found: DataFrame) -> DataFrame:
        return self.merge_score(found)

    def render_items(self, merged: DataFrame) -> DataFrame:
        """(qid, evidence_id, score, content) in a form that prompts can hold."""
        about = self.units.select("unit_id", "section_id", "text")
        return merged.join(about, "unit_id").select("qid", "evidence_id", "score", self.render_content().alias("content"))


@dataclass
class IndexRetriever(RetrieverBase):
    """BM25 per document, boosted by structure and entities, the best of each document kept."""

    def load_index(self) -> bm25.Index:
        return bm25.shared_index(self.units, "unit_id", "text", scope=F.col("doc_id"))

    def per_doc_top_k(self, documents: Column) -> Column:
        """How many units a document may give, by the number of documents."""
        return F.greatest(F.lit(3), F.floor(F.lit(self.stem_k) / documents))

    def score_candidate(self) -> Column:
        """What is added to BM25 for a unit (query, text, unit_type, path)."""
        none = F.lit(None).cast("string")
        return scoring.domain_boost(F.col("query"), F.col("text"), none, F.col("path"), F.col("unit_type"), self.vocabulary)

    def warmup(self) -> "IndexRetriever":
        self.load_index()
        return self

    def run_search(self, subqueries: DataFrame, targets: DataFrame) -> DataFrame:
        terms = bm25.query_terms(subqueries, "qid", "query", T.simple_tokens, "label")
        scored = bm25.label_scores(self.load_index(), terms, "qid").where("score > 0").withColumnRenamed("id", "unit_id").withColumnRenamed("scope", "doc_id")
        named = targets.select("qid").distinct()
        inside = scored.join(targets, ["qid", "doc_id"], "left_semi").unionByName(scored.join(named, "qid", "left_anti"))
        about = self.units.select("unit_id", "text", "unit_type", F.col("section_id").alias("path"))
        rows = inside.join(about, "unit_id").join(subqueries.select("qid", "label", "query", "topk"), ["qid", "label"])
        rows = rows.withColumn("score", F.round(F.col("score") + self.score_candidate(), 4))
        counted = rows.join(rows.groupBy("qid", "label").agg(F.count_distinct("doc_id").alias("documents")), ["qid", "label"])
        best = bm25.top_k(counted, ["qid", "label", "doc_id"], self.per_doc_top_k(F.col("documents")), "unit_id", rank="doc_rank")
        return bm25.top_k(best, ["qid", "label"], F.col("topk"), "doc_id", "unit_id").select("qid", "label", "unit_id", "doc_id", "score")


@dataclass
class ClaimWorkflow:
    """The claim workflow's stages, each to be overridden: plan, retrieve, pool, verify, reflect, retrieve again, answer."""

    retriever: Retriever
    client: object
    method: Method = field(default_factory=lambda: METHODS["m06"])
    vocabulary: Vocabulary = CHINESE

    def plan(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(claims, one per option; groups of queries: one for the stem and one per option)"""
        options = questions.select("qid", "answer_format", "question", "doc_ids", F.explode("options").alias("option", "claim"))
        return options.withColumn("flags", claims.risk_flags(F.col("claim"), self.vocabulary.risk)).withColumn("operation", claims.operation(F.col("flags"))), claims.evidence_groups(questions, self.method.stem_k, self.method.option_k)

    def gather(self, questions: DataFrame, groups: DataFrame) -> DataFrame:
        """Round one: items of all groups (qid, evidence_id, label, covers, score, content)."""
        found = self.retriever.retrieve(questions)
        texts = self.retriever.units.select("unit_id", F.col("text").alias("content"))
        covered = groups.select("qid", F.when(F.col("mode") == "global", "stem").otherwise(F.concat(F.lit("option_"), F.get("covers", F.lit(0)))).alias("label"), "covers")
        return found.join(texts, "unit_id").join(covered, ["qid", "label"])

    def pool(self, items: DataFrame) -> DataFrame:
        return search.pool_evidence(items)

    def facts(self, pooled: DataFrame) -> DataFrame:
        """(qid, option, facts: array, n_facts)"""
        return claims.facts_per_option(pooled)

    def answer(self, verified: DataFrame) -> DataFrame:
        return claims.aggregate_answers(verified)

    def verify(self, options: DataFrame, facts: DataFrame) -> DataFrame:
        """(qid, answer_format, option, status, confidence); without facts mixed at 0, without a client mixed at 0.3."""
        from gleanery.functions.answers import verdict
        from gleanery.plans.models import ask
        from gleanery.sources.scratch import materialise

        rows = options.join(facts, ["qid", "option"], "left").withColumn("body", F.array_join(F.coalesce("facts", F.array().cast("array<string>")), "\n"))
        if self.client is None:
            return rows.select("qid", "answer_format", "option", F.lit("mixed").alias("status"), F.when(F.col("body") == "", 0.0).otherwise(0.3).alias("confidence"))
        asked = rows.select("qid", "answer_format", "option", "body", F.concat_ws("\n", "body", "question", "claim", F.lit("supported, contradicted or mixed?")).alias("prompt"))
        said = materialise(ask(asked, self.client), "workflow-verify")
        status, sure = verdict(F.col("raw_answer"))
        none = F.col("body") == ""
        return said.select("qid", "answer_format", "option", F.when(none, "mixed").otherwise(status).alias("status"), F.when(none, 0.0).otherwise(sure).alias("confidence"))

    def run(self, questions: DataFrame) -> DataFrame:
        options, groups = self.plan(questions)
        pooled = self.pool(self.gather(questions, groups))
        return self.answer(self.verify(options, self.facts(pooled)))


def launch(arguments: list[str] | None = None, spark=None) -> DataFrame:
    """Answer a file of questions with a method, from the command line::

        python -m gleanery.plans.workflow --questions q.json --domain research --units units.parquet --method m05 --out answers
    """
    import argparse

    from gleanery.plans.models import StubModel
    from gleanery.session import local_session
    from gleanery.sources.files import load_questions
    from gleanery.sources.sinks import append_results, resume, save_answers, save_evidence

    parser = argparse.ArgumentParser(description="Answer questions over units")
    parser.add_argument("--questions", required=True)
    parser.add_argument("--domain", default="research")
    parser.add_argument("--units", required=True)
    parser.add_argument("--method", default="m05", choices=sorted(METHODS))
    parser.add_argument("--out", required=True)
    parser.add_argument("--final-k", type=int)
    parser.add_argument("--limit", type=int, help="number of questions, by qid, for trial runs")
    parser.add_argument("--resume", action="store_true", help="leave out questions that the output already holds")
    given = parser.parse_args(arguments)
    spark = spark or local_session()
    method = METHODS[given.method].with_overrides(**({"final_k": given.final_k} if given.final_k else {}))
    questions = load_questions(spark, {given.domain: given.questions})
    if given.resume:
        questions = resume(questions, f"{given.out}/results")
    if given.limit:
        questions = questions.orderBy("qid").limit(given.limit)
    got = answer_questions(questions, spark.read.parquet(given.units), method, StubModel())
    append_results(got, f"{given.out}/results")
    whole = spark.read.parquet(f"{given.out}/results").withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    save_answers(whole, f"{given.out}/answers")
    save_evidence(whole, f"{given.out}/evidence")
    return got


if __name__ == "__main__":
    launch()
