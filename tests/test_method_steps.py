"""Steps of methods change their evidence."""

import pytest

from gleanery.functions.vocab import LATIN
from gleanery.plans.methods import METHODS, best_units

QUESTIONS = "qid string, question string, options map<string,string>, answer_format string, doc_ids array<string>, domain string"


@pytest.fixture(scope="module")
def asked(spark):
    lines = [
        ("d1/0", "heading", "Grain."), ("d1/0", "text", "grain harvest 2019 was poor"), ("d1/0", "text", "grain harvest"),
        ("d1/1", "heading", "License terms."), ("d1/1", "financial_field", "License = grain 2021 and more of other words in a long line"), ("d1/2", "heading", "Rest."), ("d1/2", "text", "harvest of apples"),
    ]
    units = spark.createDataFrame([(f"d1:{i}", "d1", s, i, k, t, "en") for i, (s, k, t) in enumerate(lines)], "unit_id string, doc_id string, section_id string, ord bigint, unit_type string, text string, domain string")
    questions = spark.createDataFrame([("q", "License for grain harvest 2021", {"A": "grain", "B": "harvest"}, "mcq", ["d1"], "en")], QUESTIONS)
    return questions, units


def scores(asked, method):
    return {r["unit_id"]: r["score"] for r in best_units(*asked, method, LATIN).collect()}


def test_boost(asked):
    plain, boosted = scores(asked, METHODS["m05"].with_overrides(boost=False)), scores(asked, METHODS["m05"])
    assert max(boosted, key=boosted.get) == "d1:4"
    # Metric 3, year 1.2, field 1.5, and 0.6 for the number.
    assert boosted["d1:4"] - plain["d1:4"] == pytest.approx(6.3, abs=1e-3)


def test_rescoring(asked):
    m05, m08 = scores(asked, METHODS["m05"]), scores(asked, METHODS["m08"])
    assert m05 != m08 and m08["d1:4"] > m05["d1:4"] + 4


def test_routing(asked):
    routed = METHODS["m07"].with_overrides(least_routed=1)
    assert set(scores(asked, routed)) <= set(scores(asked, routed.with_overrides(routed=False)))
    # Too few hits in the routed sections: one query of the stem and all options over everything.
    assert scores(asked, METHODS["m07"].with_overrides(least_routed=99)) != scores(asked, routed)
