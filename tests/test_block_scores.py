"""BM25 in blocks gives what joins give, however queries and texts are cut."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import blocks, bm25


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [(f"{i % 90}:{i}", i % 90, "xyz"[i % 3], " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(700)] + [("0:n", 0, "x", None), ("5:c", 5, "y", "w1 w1 w2"), ("5:d", 5, "y", "w1 w1 w2")]
    docs = spark.createDataFrame(texts, "id string, doc bigint, lang string, text string").repartition(6)
    asked = spark.createDataFrame([(i, label, " ".join(rng.choices(words + ["unknown"], k=5))) for i in range(25) for label in ("stem", "a")] + [(99, "a", "unknown")], "qid bigint, label string, text string")
    return docs, bm25.query_terms(asked, "qid", "text", bm25.simple_tokens, "label")


def shown(df, *columns):
    return sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in (r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("cells", [blocks.CELLS, 300])
@pytest.mark.parametrize("scope,okapi", [(None, False), (None, True), ("lang", True), ("doc", False)])
def test_best_as_by_joins(made, monkeypatch, cells, scope, okapi):
    monkeypatch.setattr(bm25, "MOST_CELLS", cells)
    docs, terms = made
    index = bm25.build_index(docs, "id", "text", scope=F.col(scope) if scope else None)
    monkeypatch.setattr(bm25, "MANY_SCOPES", 10)
    allowed = docs.where("lang != 'x'").select("id") if scope != "doc" else None
    got = bm25.best(index, terms, "qid", 4, "label", okapi=okapi, allowed=allowed)
    scored = bm25.bm25_scores(index, terms, "qid", "label", okapi=okapi).where("score > 0").withColumn("score", F.round("score", 4))
    want = bm25.top_k(scored.join(allowed, "id", "left_semi") if allowed else scored, ["qid", "label"], 4, "id")
    columns = ("qid", "label", "scope", "id", "score", "rank")
    assert shown(got, *columns) == shown(want, *columns) and got.count() > 150


def test_two_levels_as_by_joins(made, monkeypatch):
    docs, terms = made
    for rows, asked in ((docs, terms), (docs.where("doc < 2"), terms), (docs.where("doc = 1"), terms)):
        index = bm25.build_index(rows, "id", "text", scope=F.col("doc"))
        asked = asked.where("label = 'a'").drop("label")
        got = bm25.two_level_best(index, asked, "qid", 10)
        scored = bm25.bm25_scores(index, asked, "qid").withColumn("score", F.round("score", 4)).where("score > 0")
        columns = ("qid", "scope", "id", "score", "doc_rank", "rank")
        assert shown(got, *columns) == shown(bm25.two_level_top_k(scored, "qid", "scope", 10, "id"), *columns)


def test_too_many_terms_go_by_joins(made, monkeypatch):
    docs, terms = made
    index = bm25.build_index(docs, "id", "text")
    want = shown(bm25.ranked(index, terms, "qid", 3, "label"), "qid", "label", "id", "score", "rank")
    monkeypatch.setattr(bm25, "MOST_TERMS", 1)
    assert bm25.best(index, terms, "qid", 3, "label") is None
    assert shown(bm25.ranked(index, terms, "qid", 3, "label"), "qid", "label", "id", "score", "rank") == want


def test_boost_by_marks(spark, sf):
    from gleanery.functions.vocab import LATIN
    from gleanery.operators import scoring
    from gleanery.plans import queries_search as Q

    units = Q.turns(spark, sf).select(F.col("unit_id").alias("id"), "text", "name", "path", "unit_type")
    asked = Q.asked(spark, sf)
    base, weights = scoring.boost_marks(asked, ["qid"], "query", units, LATIN)
    added = base.select("id", F.explode("marks").alias("mark")).join(weights, "mark").groupBy("qid", "id").agg(F.sum("weight").alias("w"))
    boost = scoring.domain_boost(F.col("query"), F.col("text"), F.col("name"), F.col("path"), F.col("unit_type"), LATIN) + scoring.word_bonus(F.col("query"), F.col("text"))
    pairs = units.crossJoin(asked).select("qid", "id", boost.alias("want")).join(base, "id").join(added, ["qid", "id"], "left")
    off = pairs.where("abs(want - base - coalesce(w, 0)) > 1e-9")
    assert pairs.where("w > 0").count() > 0 and off.count() == 0


def test_hits_of_methods_as_by_joins(spark, sf, monkeypatch):
    from gleanery.functions.vocab import LATIN
    from gleanery.plans import queries_runs
    from gleanery.plans.methods import METHODS, hits

    questions, units = queries_runs.asked(spark, sf)
    questions = questions.withColumn("doc_ids", F.when(F.col("qid").endswith("3"), F.array(F.lit(1), F.lit(5)).cast("array<bigint>")).otherwise(F.col("doc_ids")))
    for name in ("m02", "m05"):
        got = shown(hits(questions, units, METHODS[name], vocabulary=LATIN), "qid", "label", "unit_id", "doc_id", "score")
        with monkeypatch.context() as patch:
            patch.setattr(bm25, "MOST_TERMS", 0)
            want = shown(hits(questions, units, METHODS[name], vocabulary=LATIN), "qid", "label", "unit_id", "doc_id", "score")
        assert got == want and any(r[0].endswith("3") for r in got)


def test_hashed_vector_counts_words(spark):
    from gleanery.operators.retrieval import hashed_vector

    rows = spark.createDataFrame([("a b a c7 12.5%",), ("",), (None,)], "text string").select(hashed_vector(F.col("text")).alias("v"), hashed_vector(F.col("text"), 1).alias("one")).collect()
    assert [sum(r["v"]) for r in rows] == [5, 0, 0] and [r["one"] for r in rows] == [[5], [0], [0]] and {len(r["v"]) for r in rows} == {64}
    place = spark.sql("SELECT pmod(xxhash64('a'), 64)").first()[0]
    assert rows[0]["v"][place] >= 2
