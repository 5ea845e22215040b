"""Retrievers and workflows whose steps are replaced, methods as compositions, cache builder, writers, launcher."""

import collections
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from gleanery.functions.vocab import LATIN
from gleanery.operators import retrieval, search
from gleanery.plans import methods as M
from gleanery.plans import workflow as W
from gleanery.plans.models import StubModel
from gleanery.sources import sinks

UNITS = "unit_id string, doc_id string, section_id string, ord bigint, unit_type string, text string, domain string"
QUESTIONS = "qid string, question string, options map<string,string>, answer_format string, doc_ids array<string>, domain string"


@pytest.fixture(scope="module")
def tables(spark):
    words = "grain harvest market price License token river stone 2019 2021 20% 7".split()
    rows = [(f"d{d}:{i}", f"d{d}", f"d{d}/{i // 4}", i, "text" if i % 3 else "financial_field", " ".join(words[(d * 5 + i * k) % len(words)] for k in range(1, 6)), "en") for d in range(4) for i in range(12)]
    asked = [(f"q{i}", f"{words[i]} {words[i + 3]} {words[i + 5]} 20%", {"A": words[i + 1], "B": f"{words[i + 2]} price"}, ["multi", "mcq", "tf"][i % 3], ["d0", "d2"] if i % 2 else [], "en") for i in range(6)]
    return spark.createDataFrame(asked, QUESTIONS), spark.createDataFrame(rows, UNITS), asked, rows


def ranked(scores, k):
    return [u for u, s in sorted(scores.items(), key=lambda x: (-x[1], x[0])) if s > 0][:k]


def plain_vector(text, places):
    out = [0.0] * 64
    for w in re.findall(r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)?%?", text.lower()):
        out[places[w]] += 1
    return out


def test_fusion_of_m02(spark, tables):
    """BM25 and vector lists of stem and options, fused by reciprocal ranks, against plain Python."""
    questions, units, asked, rows = tables
    method = M.METHODS["m02"]
    lexical = collections.defaultdict(list)
    for r in M.hits(questions, units, method, vocabulary=LATIN).collect():
        lexical[r["qid"], r["label"]].append((-r["score"], r["unit_id"]))
    tokens = {w for _, _, _, _, _, t, _ in rows for w in t.lower().split()} | {w for q in asked for x in (q[1], *q[2].values(), "a", "b") for w in re.findall(r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)?%?", x.lower())}
    places = {r["w"]: r["p"] for r in spark.createDataFrame([(w,) for w in tokens], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(64)).alias("p")).collect()}
    vectors = {u: plain_vector(t, places) for u, _, _, _, _, t, _ in rows}
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for qid, question, options, _, docs, _ in asked:
        fused = collections.Counter()
        for label, query in [("stem", question), *((f"option_{k}", f"{question}\n{k}. {v}") for k, v in options.items())]:
            q = plain_vector(query, places)
            near = {u: round(sum(a * b for a, b in zip(q, v)) / (norm(q) * norm(v)), 6) for u, v in vectors.items() if (not docs or u.split(":")[0] in docs) and norm(v)}
            for found in ([u for _, u in sorted(lexical[qid, label])][:10], ranked(near, 10)):
                for place, u in enumerate(found):
                    fused[u] += 1 / (60 + place + 1)
        got = [(r["unit_id"], r["score"]) for r in M.best_units(questions, units, method, LATIN).where(F.col("qid") == qid).orderBy("rank").collect()]
        want = sorted(((u, round(s, 6)) for u, s in fused.items()), key=lambda x: (-x[1], x[0]))[:8]
        assert got == want


def test_steps_change_what_is_found(tables):
    questions, units, *_ = tables
    best = lambda m: sorted((r["qid"], r["unit_id"], r["score"]) for r in M.best_units(questions, units, m, LATIN).collect())
    m01, m05c = M.METHODS["m01"], M.METHODS["m05c"]
    numbers = M.number_hits(questions, units).collect()
    assert numbers and all("20%" in u["text"] or "20" in u["text"] for u in units.join(M.number_hits(questions, units).select("unit_id").distinct(), "unit_id").collect())
    assert best(m01) != best(m01.with_overrides(numbers=False)) and best(m01) != best(m01.with_overrides(summed=False))
    cards = M.card_hits(questions, units, m05c.with_overrides(card_k=99), LATIN, strong=("en",)).collect()
    assert cards and {r["label"] for r in cards} == {"card"}
    assert all(c["doc_id"] in ("d0", "d2") for c in cards if int(c["qid"][1:]) % 2)


def test_retriever_hooks(tables):
    questions, units, *_ = tables

    class Half(W.IndexRetriever):
        def resolve_targets(self, questions):
            return super().resolve_targets(questions).where("doc_id = 'd2'")

        def per_doc_top_k(self, documents):
            return F.lit(1)

        def render_content(self):
            return F.upper("text")

    plain, half = W.IndexRetriever(units, LATIN).warmup(), Half(units, LATIN)
    found = half.retrieve(questions).collect()
    assert {r["doc_id"] for r in found if int(r["qid"][1:]) % 2} == {"d2"}
    assert max(collections.Counter((r["qid"], r["label"], r["doc_id"]) for r in found).values()) == 1
    merged = half.merge(half.retrieve(questions))
    shown = half.render_items(merged).collect()
    assert shown and all(r["content"] == r["content"].upper() for r in shown) and len(shown) == merged.count()
    assert plain.retrieve(questions).count() > len(found)
    with pytest.raises(NotImplementedError):
        W.RetrieverBase(units).retrieve(questions)


def test_workflow_stages(tables):
    questions, units, asked, _ = tables

    class Sure(W.ClaimWorkflow):
        def verify(self, options, facts):
            return super().verify(options, facts).withColumn("status", F.when(F.col("option") == "B", "supported").otherwise("contradicted")).withColumn("confidence", F.lit(0.9))

    retriever = W.IndexRetriever(units, LATIN)
    got = {r["qid"]: r["answer"] for r in Sure(retriever, None, vocabulary=LATIN).run(questions).collect()}
    assert got == {q[0]: "B" for q in asked}
    flow = W.ClaimWorkflow(retriever, None, vocabulary=LATIN)
    options, groups = flow.plan(questions)
    assert options.count() == 12 and groups.count() == 18
    pooled = flow.pool(flow.gather(questions, groups))
    assert pooled.count() == pooled.select("qid", "evidence_id").distinct().count() > 0
    assert {r["confidence"] for r in flow.verify(options, flow.facts(pooled)).collect()} <= {0.0, 0.3}
    assert flow.run(questions).count() == 6 and W.ClaimWorkflow(retriever, StubModel(), vocabulary=LATIN).run(questions).count() == 6


def test_small_operators(spark):
    anchors = spark.createDataFrame([("u", "f", "s"), (None, "f", "s"), ("", None, "s"), (None, None, None)], "u string, f string, s string")
    keys = [r["k"] for r in anchors.select(search.anchor_key(F.col("u"), F.col("f"), F.col("s"), F.struct("u", "f")).alias("k")).collect()]
    assert keys[:3] == ["u", "f", "s"] and len(keys[3]) == 16
    hay = spark.createDataFrame([("a", None, ["x", "y", "z", "w"])], "a string, b string, near array<string>")
    assert hay.select(search.haystack([F.col("a"), F.col("b")], F.col("near")).alias("h")).first()["h"] == "a x y z"
    chunks = spark.createDataFrame([("q", 2, "T2", "two"), ("q", 1, "T1", "one")], "qid string, n int, title string, text string")
    assert search.render_chunks(chunks, "qid", ["n"], F.col("title"), "text").first()["evidence"] == "[T1]\none\n---\n[T2]\ntwo"
    vector = spark.range(1).select(retrieval.hashed_vector(F.lit("a b a")).alias("v")).first()["v"]
    assert len(vector) == 64 and sorted(vector)[-2:] in ([1.0, 2.0], [0.0, 3.0])


def test_cache_builder(spark, tmp_path):
    wanted = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "doc_id string, domain string")
    calls = []

    def build(todo):
        calls.append(sorted(r["doc_id"] for r in todo.collect()))
        return todo.where("doc_id != 'c'").select("doc_id", F.lit(len(calls)).alias("page"), F.lit("text").alias("text"))

    folder = str(tmp_path / "cache")
    first = {r["doc_id"]: r["status"] for r in sinks.build_cache(wanted, build, folder).collect()}
    assert first == {"a": "success", "b": "success", "c": "failed"}
    second = {r["doc_id"]: r["status"] for r in sinks.build_cache(wanted, build, folder).collect()}
    assert second == {"a": "skipped", "b": "skipped", "c": "failed"}
    sinks.build_cache(wanted, build, folder, force=True)
    assert calls == [["a", "b", "c"], ["c"], ["a", "b", "c"]]
    blocks = spark.read.parquet(f"{folder}/blocks").collect()
    assert sorted((r["doc_id"], r["page"]) for r in blocks) == [("a", 3), ("b", 3)]
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{folder}/manifest").collect()) == ["a", "b"]


def test_writers(spark, tmp_path):
    items = spark.createDataFrame([("q1", "x", 1, 0.5, False), ("q1", "x", 2, 0.4, True), ("q2", "y", 1, 0.9, False)], "qid string, domain string, rank bigint, score double, hit boolean")
    sinks.write_diagnostics(items, str(tmp_path / "d"))
    assert {(r["qid"], r["first"]) for r in spark.read.json(str(tmp_path / "d/questions")).collect()} == {("q1", 2), ("q2", 0)}
    results = spark.createDataFrame([("q1", "x", "A"), ("q2", "y", "B"), ("q3", "y", "C")], "qid string, domain string, answer string")
    sinks.write_comparison(results, spark.createDataFrame([("q1", "A"), ("q2", "C")], "qid string, answer string"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c/comparison_json")).count() == 3
    assert {(r["domain"], r["accuracy"]) for r in spark.read.json(str(tmp_path / "c/accuracy")).select("accuracy", "domain").collect()} == {("x", 1.0), ("y", 0.0), (None, 0.5)}


def test_launcher(spark, tables, tmp_path):
    _, units, asked, _ = tables
    units.write.parquet(str(tmp_path / "units"))
    (tmp_path / "q.json").write_text(json.dumps([{"qid": q, "question": t, "options": o, "answer_format": f, "doc_ids": d} for q, t, o, f, d, _ in asked]))
    arguments = ["--questions", str(tmp_path / "q.json"), "--units", str(tmp_path / "units"), "--out", str(tmp_path / "out"), "--method", "m05"]
    W.launch([*arguments, "--limit", "2"], spark)
    W.launch([*arguments, "--resume"], spark)
    answers = spark.read.csv(str(tmp_path / "out/answers"), header=True).collect()
    assert sorted(r["qid"] for r in answers) == sorted(["summary", *(q[0] for q in asked)])
