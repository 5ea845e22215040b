"""The second round of claims runs the actions' own queries."""

from gleanery.functions.vocab import LATIN
from gleanery.plans.methods import METHODS, action_queries, claim_workflow, with_leads

UNITS = "unit_id string, doc_id string, section_id string, ord bigint, unit_type string, text string, domain string"
QUESTIONS = "qid string, question string, options map<string,string>, answer_format string, doc_ids array<string>, domain string"


def test_queries_of_actions(spark):
    options = spark.createDataFrame(
        [("q", "A", "which both", "MIT License did not grow in 2021", ["d1", "d2"]), ("q", "B", "which", "均 grew", ["d1", "d2"])], "qid string, option string, question string, claim string, doc_ids array<string>"
    )
    actions = spark.createDataFrame([("q", "option_search", "A", ""), ("q", "metric_search", "A", ""), ("q", "counter_search", "A", ""), ("q", "option_search", "B", "d2")], "qid string, tool string, option string, entity string")
    got = {r["label"]: (r["query"], r["topk"], r["only"]) for r in action_queries(with_leads(options, LATIN, ["均"]), actions, METHODS["m06"]).collect()}
    assert got == {
        "A|option_search|": ("Apache 2021 licence MIT License did not grow in 2021", 20, None), "A|metric_search|": ("Apache 2021年 licence", 10, None),
        "A|counter_search|": ("MIT License did indeed grow in 2021", 8, None), "B|option_search|d2": ("均 grew", 20, "d2"),
    }


def test_counter_evidence_counts(spark):
    # Only the turned claim ("indeed" for "not") finds the third line.
    lines = ["sales did not grow", "costs grew", "indeed otherwise", "unrelated words"]
    units = spark.createDataFrame([(f"d1:{i}", "d1", "d1/0", i, "text", t, "research") for i, t in enumerate(lines)], UNITS)
    questions = spark.createDataFrame([("q", "year", {"A": "sales did not grow", "B": "costs grew"}, "mcq", ["d1"], "research")], QUESTIONS)

    def client(prompt):
        # Facts of the first round stay beside the counter-evidence.
        if "sales did not grow\nCounter-evidence:\nindeed otherwise" in prompt.replace("costs grew\n", ""):
            return '{"status": "contradicted", "confidence": 0.95}', 1, 1
        return '{"status": "supported", "confidence": %s}' % ("0.9" if prompt.count("sales") > 1 else "0.7"), 1, 1

    got = claim_workflow(questions, units, METHODS["m06"], client, vocabulary=LATIN).collect()
    assert [r["answer"] for r in got] == ["B"]
