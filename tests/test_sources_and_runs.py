import json

import pytest
from pyspark.sql import functions as F

from gleanery.plans.methods import METHODS, Method, answer_questions, claim_workflow, register
from gleanery.plans.models import StubModel, ask
from gleanery.sources import files as R
from gleanery.sources import sinks as W
from gleanery.streaming.events import answer_stream, hourly, sessions

QUESTIONS = [
    {"qid": "res_1", "question": "alpha beta", "options": {"A": "alpha one", "B": "beta two"}, "answer_format": "multi", "doc_ids": ["d1"]},
    {"qid": "res_2", "question": "gamma", "options": {"A": "x", "B": "y"}, "answer_format": "mcq", "doc_id": "d2", "domain": "own"},
]


@pytest.fixture()
def questions(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps(QUESTIONS))
    return R.load_questions(spark, {"research": str(path), "missing": str(tmp_path / "none.json")})


@pytest.fixture()
def units(spark):
    rows = [("d1:0", "d1", "d1/0", 0, "text", "alpha beta gamma"), ("d1:1", "d1", "d1/0", 1, "text", "beta delta"), ("d2:0", "d2", "d2/0", 0, "text", "gamma one two"), ("d2:1", "d2", "d2/0", 1, "table_row", "x | y")]
    return spark.createDataFrame(rows, "unit_id string, doc_id string, section_id string, ord bigint, unit_type string, text string").withColumn("domain", F.lit("research"))


def test_load_questions(questions):
    got = {r["qid"]: r for r in questions.collect()}
    assert got["res_1"]["domain"] == "research" and got["res_2"]["domain"] == "own" and got["res_2"]["doc_ids"] == ["d2"]


def test_resolve_paths(spark, tmp_path):
    for name in ("a.PDF", "a.pdf", "strict_v3_1_x.txt", "csrc_9.html", "csrc_9_att1.pdf"):
        (tmp_path / name).write_text("x")
    wanted = spark.createDataFrame([("a", "insurance"), ("strict_v3_1", "regulatory"), ("csrc_9", "regulatory"), ("csrc_9_att1", "regulatory"), ("no", "research")], "doc_id string, domain string")
    got = {r["doc_id"]: (r["path"] or "").rsplit("/", 1)[-1] for r in R.resolve_paths(wanted, R.list_files(spark, str(tmp_path))).collect()}
    assert got == {"a": "a.PDF", "strict_v3_1": "strict_v3_1_x.txt", "csrc_9": "csrc_9.html", "csrc_9_att1": "csrc_9_att1.pdf", "no": ""}


def test_text_and_pdf_blocks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("开头\n\n第一章 总则\n内容\n第二章 分则\n更多")
    docs = R.read_texts(spark, spark.createDataFrame([("t", "regulatory", str(tmp_path / "t.txt"))], "doc_id string, domain string, path string"))
    got = R.text_blocks(docs).orderBy("seq").collect()
    assert [(r["section_title"], r["text"]) for r in got] == [("", "开头"), ("第一章 总则", "第一章 总则\n内容"), ("第二章 分则", "第二章 分则\n更多")]

    def broken(data):
        raise ValueError

    def pages(data):
        return [{"page_num": 1, "text": "第一节 x\nbody", "tables": [[["a", None], ["1", "2"]]]}, {"page_num": 2, "text": " "}]

    files = spark.createDataFrame([("p", "research", bytearray(b"%PDF"))], "doc_id string, domain string, content binary")
    got = R.decode_pdfs(files, [broken, pages], with_tables=True).collect()
    assert len(got) == 1 and got[0]["section_title"] == "第一节 x" and got[0]["text"].endswith("[TABLE]\na | \n1 | 2")
    lines = spark.createDataFrame([("p", 1, 5.0, 10.04, "b", 9.0), ("p", 1, 1.0, 10.0, "a", 9.0), ("p", 1, 0.0, 2.0, "top", 9.0)], "doc_id string, page_num int, x0 double, y0 double, text string, font_size double")
    assert [r["text"] for r in R.page_lines(lines).orderBy("ord").collect()] == ["top", "a", "b"]


def test_load_answers(spark, tmp_path):
    made = {"a.csv": "qid,answer,total_tokens\nsummary,,9\nq1,A,1\n", "b.json": '{"q1": "A"}', "c.json": '{"q1": {"answer": "A"}}', "d.json": '[{"question_id": "q1", "final_answer": "A"}]'}
    for name, text in made.items():
        (tmp_path / name).write_text(text)
        assert [tuple(r) for r in R.load_answers(spark, str(tmp_path / name)).collect()] == [("q1", "A")], name
    (tmp_path / "bad.json").write_text('{"q1": "A')
    assert R.load_answers(spark, str(tmp_path / "bad.json")).count() == 0


def test_index_files(spark, tmp_path):
    for doc, names in {"d1": ("sections", "units"), "d2": ("sections",)}.items():
        (tmp_path / doc).mkdir()
        for n in names:
            R.json_lines([{"doc_id": doc, "section_id": "s"}], str(tmp_path / doc / f"{n}.jsonl"))
    got = R.load_index(spark, str(tmp_path), spark.createDataFrame([("d1",), ("d2",)], "doc_id string"))
    assert {r["doc_id"] for r in got["sections"].collect()} == {"d1"} and "field_cards" not in got


def test_sinks(spark, tmp_path):
    results = spark.createDataFrame([("q2", "B", 5, 1, 6), ("q1", "A", None, 2, 2)], "qid string, answer string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint")
    W.save_answers(results, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv")).split("\n")
    assert text[0].startswith("qid,answer") and text[1].startswith("summary") and text[2].startswith("q1") and text[3].startswith("q2")
    wanted = results.select("qid")
    assert W.resume(wanted, str(tmp_path / "parts")).count() == 2
    W.append_results(results.where("qid = 'q1'"), str(tmp_path / "parts"))
    assert [r["qid"] for r in W.resume(wanted, str(tmp_path / "parts")).collect()] == ["q2"]
    run = W.Run("me", "m05", {"b": 1, "a": 2})
    assert run.config_hash == W.Run("you", "m05", {"a": 2, "b": 1}).config_hash and len(run.config_hash) == 12
    run.finish(accuracy=0.5).write(spark, str(tmp_path))
    assert spark.read.json(str(tmp_path / "runs")).first()["status"] == "success"
    W.write_tables({"t": results.withColumn("domain", F.lit("x"))}, str(tmp_path))
    assert (tmp_path / "t" / "domain=x").exists()


def test_methods(spark, questions, units):
    assert register(Method("own", stem_k=1)).with_overrides(stem_k=2).stem_k == 2
    for name in ("m01", "m03", "m04", "m05a"):
        got = answer_questions(questions, units, METHODS[name], StubModel(1)).collect()
        assert sorted(r["qid"] for r in got) == ["res_1", "res_2"] and all(r["answer"] and set(r["answer"]) <= set("ABCD") for r in got)
    got = {r["qid"]: r for r in answer_questions(questions, units, METHODS["m05"], StubModel(1)).collect()}
    assert "alpha beta gamma" in got["res_1"]["evidence"] and "gamma one two" not in got["res_1"]["evidence"]


def test_claims(spark, questions, units):
    def client(prompt):
        return ('{"status": "supported", "confidence": 0.9}' if "alpha one" in prompt else "no idea"), 1, 1

    got = {r["qid"]: r["answer"] for r in claim_workflow(questions, units, METHODS["m06"], client).collect()}
    assert got["res_1"] == "A" and set(got) == {"res_1", "res_2"}


def test_failing_model(spark):
    def client(prompt):
        raise RuntimeError("down")

    got = ask(spark.createDataFrame([("q", "p")], "qid string, prompt string"), client, attempts=2, wait=0.0).first()
    assert got["raw_answer"] == "" and got["error"] == "down"


def test_streams(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(json.dumps(q) for q in QUESTIONS))

    def answer(questions):
        return questions.select("qid", F.lit("A").alias("answer"))

    for _ in range(2):
        answer_stream(spark, str(inbox), answer, str(tmp_path / "res"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r["qid"] for r in spark.read.parquet(str(tmp_path / "res")).collect()) == ["res_1", "res_2"]
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS ts, 'x' AS event_type, 1.0D AS value, id % 2 AS user_id FROM range(10)")
    assert hourly(events).count() == 4 and sessions(events, "50 minutes").count() == 2


def test_index_is_kept(spark, units, tmp_path):
    from gleanery.operators import bm25

    index = bm25.build_index(units, "unit_id", "text")
    index.save(str(tmp_path / "ix"))
    again = bm25.Index.load(spark, str(tmp_path / "ix"))
    terms = bm25.query_terms(spark.createDataFrame([("q", "alpha gamma gamma")], "qid string, t string"), "qid", "t")
    shown = lambda x: sorted((r["id"], round(r["score"], 6)) for r in bm25.bm25_scores(x, terms, "qid").collect())
    assert shown(index) == shown(again) and [i for i, _ in shown(index)] == ["d1:0", "d2:0"]


def test_cache(spark, tmp_path):
    blocks = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, domain string")
    W.write_tables({"blocks": blocks}, str(tmp_path))
    assert R.to_parse(blocks, spark.read.parquet(str(tmp_path / "blocks"))).count() == 0
    assert R.clear_cache(spark, str(tmp_path / "blocks"), "x") and not R.clear_cache(spark, str(tmp_path / "blocks"), "z")
    assert [r["doc_id"] for r in R.to_parse(blocks, spark.read.parquet(str(tmp_path / "blocks"))).collect()] == ["a"]


def test_content_of(spark):
    pages = spark.createDataFrame([('<body><div class="x content">a</div><article>b</article></body>',), ("<article>b</article>",), ("plain",)], "h string")
    assert [r[0] for r in pages.select(R.content_of(F.col("h"))).collect()] == ["a", "b", "plain"]
