"""Question answering methods as compositions of operators.

A method is a configuration; :func:`answer_questions` runs it: query table, hits, merge,
evidence within a budget, prompt, model, normalised answer, and a second call for multiple
choice with one letter. Inputs: ``questions`` (qid, question, options, answer_format,
doc_ids, domain), ``units`` (unit_id, doc_id, section_id, ord, unit_type, text) and a model.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import planning as P
from gleanery.functions import text as T
from gleanery.functions.answers import normalize_answer
from gleanery.functions.vocab import CHINESE, Vocabulary
from gleanery.operators import bm25, claims, retrieval, scoring, search
from gleanery.operators import segmentation as S
from gleanery.plans.models import ask, or_default
from gleanery.sources.scratch import materialise


#: Hits of a counter-evidence and of a metric query in the second round; option queries have twice the first round's.
COUNTER_K, METRIC_K = 8, 10


@dataclass(frozen=True)
class Method:
    """Sizes and steps of one method. ``scope`` is what statistics cover."""

    name: str
    stem_k: int = 10
    option_k: int = 10
    final_k: int = 28
    siblings: int = 12
    unit_chars: int = 900
    evidence_chars: int = 48_000
    bonus: float = 1.25
    stem: bool = True
    options: bool = True
    full_text: bool = False
    scope: str = "doc_id"
    votes: int = 1
    reflect: bool = True
    okapi: bool = False
    boost: bool = False  # domain boost and word bonus on every hit's score
    rescore: bool = False  # the best hits of each document scored again by structure, entities and domain words
    routed: bool = False  # hits of chosen sections only, of all if those are fewer than ``least_routed``
    least_routed: int = 6
    dense: bool = False  # lists of BM25 and of vectors fused by reciprocal ranks instead of merged scores
    numbers: bool = False  # chunks that hold one of the question's numbers are hits too
    summed: bool = False  # scores of all hits of a unit added up instead of the best plus a bonus
    cards: bool = False  # domain cards that fit the question are hits too, if their score is good enough
    card_k: int = 6

    def with_overrides(self, **changes: object) -> "Method":
        return replace(self, **changes)


#: The published variants' sizes (fixed values).
METHODS = {
    m.name: m
    for m in (
        Method("m01", stem_k=5, option_k=2, final_k=40, siblings=0, evidence_chars=3000, scope="domain", reflect=False, okapi=True, numbers=True, summed=True),
        Method("m02", stem_k=10, option_k=10, final_k=8, siblings=0, evidence_chars=6000, scope="domain", votes=3, okapi=True, dense=True),
        Method("m03", full_text=True, stem_k=0, option_k=0, siblings=0, reflect=False),
        Method("m04", stem_k=30, options=False, final_k=30, unit_chars=800, boost=True),
        Method("m05", boost=True),
        Method("m05a", option_k=13, stem=False, boost=True),
        Method("m05b", boost=True),
        Method("m05c", bonus=1.1, boost=True, cards=True),
        Method("m06", stem_k=10, option_k=10, boost=True),
        Method("m07", stem_k=8, option_k=8, final_k=24, siblings=8, evidence_chars=44_000, boost=True, routed=True),
        Method("m08", boost=True, rescore=True),
    )
}


def hits(questions: DataFrame, units: DataFrame, method: Method, table: DataFrame | None = None, vocabulary: Vocabulary = CHINESE, sections: DataFrame | None = None) -> DataFrame:
    """(qid, label, unit_id, score) of every query of the method, within a question's documents.

    ``table`` gives other queries (qid, label, query, topk), and perhaps ``only``, a document to look in;
    ``sections`` (qid, section_id) those to keep of the best max(80, 30 k).
    """
    index = bm25.shared_index(units, "unit_id", "text", scope=F.col(method.scope))
    if table is None:
        table = S.option_queries(questions, method.stem_k, method.option_k, method.stem)
        if not method.options:
            table = table.where("label = 'stem'")
    more = ["label", "topk", *(c for c in table.columns if c == "only")]
    free = None
    if not method.rescore and sections is None:
        # Queries that may look anywhere are scored in blocks; those with documents of their own by joins below.
        anywhere = F.size("doc_ids") == 0
        anywhere = anywhere & F.col("only").isNull() if "only" in more else anywhere
        asked = materialise(table.join(questions.select("qid", "doc_ids"), "qid").withColumn("__anywhere", F.coalesce(anywhere, F.lit(False))), f"queries-{method.name}")
        free = _hits_anywhere(asked.where("__anywhere"), units, index, method, vocabulary)
        if free is not None:
            if not asked.where("not __anywhere").limit(1).count():
                return free
            table = asked.where("not __anywhere").drop("doc_ids", "__anywhere")
    terms = bm25.query_terms(table, "qid", "query", T.simple_tokens, "label")
    scored = bm25.label_scores(index, terms, "qid", okapi=method.okapi).withColumn("score", F.round("score", 4)).where("score > 0")
    placed = scored.join(table.select("qid", *more), ["qid", "label"]).join(units.select(F.col("unit_id").alias("id"), "doc_id"), "id")
    # Statistics stay those of the whole scope: documents are cut out after scoring.
    allowed = placed.join(questions.select("qid", "doc_ids"), "qid").where(F.expr("size(doc_ids) = 0 or array_contains(doc_ids, doc_id)"))
    if "only" in more:
        allowed = allowed.where("only is null or cast(doc_id as string) = only")
    if method.boost or method.rescore:
        allowed = allowed.join(_about(units).drop("name"), "id").join(table.select("qid", "label", "query"), ["qid", "label"])
    place = (F.col("query"), F.col("text"), F.lit(None).cast("string"), F.col("path"), F.col("unit_type"))
    if method.boost:
        allowed = allowed.withColumn("score", F.round(F.col("score") + scoring.domain_boost(*place, vocabulary) + scoring.word_bonus(F.col("query"), F.col("text")), 4))
    if method.rescore:
        allowed = bm25.top_k(allowed, ["qid", "label", "doc_id"], F.col("topk"), "id", rank="doc_rank")
        allowed = allowed.withColumn("score", F.round(F.col("score") + scoring.hybrid_score(*place, F.col("domain"), vocabulary), 4))
    if sections is not None:
        wide = bm25.top_k(allowed, ["qid", "label"], F.greatest(F.lit(80), 30 * F.col("topk")), "id", rank="wide_rank")
        inside = units.select(F.col("unit_id").alias("id"), "section_id")
        allowed = wide.join(inside, "id").join(sections.select("qid", "section_id").distinct(), ["qid", "section_id"], "left_semi")
    own = bm25.top_k(allowed, ["qid", "label"], F.col("topk"), "id").select("qid", "label", F.col("id").alias("unit_id"), "doc_id", "score")
    return own if free is None else own.unionByName(free)


def _about(units: DataFrame) -> DataFrame:
    paths = units.groupBy("section_id").agg(F.min_by("text", "ord").alias("path"))
    return units.select(F.col("unit_id").alias("id"), "section_id", "text", "unit_type", "domain", F.lit(None).cast("string").alias("name")).join(paths, "section_id").drop("section_id")


def _hits_anywhere(table: DataFrame, units: DataFrame, index: bm25.Index, method: Method, vocabulary: Vocabulary) -> DataFrame | None:
    """Hits of queries (qid, label, query, topk) over all units, boosted if the method says so; None if they are too many
    for blocks."""
    extra = None
    if method.boost:
        parts = scoring.boost_marks(table, ["qid", "label"], "query", _about(units), vocabulary)
        if parts is None:
            return None
        extra = bm25.Extra(*parts)
    terms = bm25.query_terms(table, "qid", "query", T.simple_tokens, "label")
    found = bm25.best(index, terms, "qid", table, "label", okapi=method.okapi, rounded=True, extra=extra)
    if found is None:
        return None
    found = materialise(found, f"hits-{method.name}")
    return found.join(units.select(F.col("unit_id").alias("id"), "doc_id"), "id").select("qid", "label", F.col("id").alias("unit_id"), "doc_id", "score")


def allowed_pairs(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows (qid, doc_id, ...) whose document is one of the question's, or whose question names none."""
    return pairs.join(questions.select("qid", "doc_ids"), "qid").where(F.expr("size(doc_ids) = 0 or array_contains(doc_ids, doc_id)")).drop("doc_ids")


def dense_hits(questions: DataFrame, units: DataFrame, method: Method, embed=retrieval.hashed_vector) -> DataFrame:
    """(qid, label, unit_id, doc_id, score): the nearest units by cosine for the stem and each option.

    ``embed`` makes a vector Column of a text Column; hashed word counts unless a model's is given.
    """
    table = S.option_queries(questions, method.stem_k, method.option_k, method.stem)
    asked = materialise(table.select("qid", "label", "topk", embed(F.col("query")).alias("qvec")).join(questions.select("qid", "doc_ids"), "qid"), "query-vectors")
    held = materialise(units.select("unit_id", "doc_id", embed(F.col("text")).alias("vec")), "unit-vectors")
    free = retrieval.dense_top_k(asked.where("size(doc_ids) = 0").drop("doc_ids"), held.select(F.col("unit_id").alias("id"), "vec"), "topk", "label")
    anywhere = free.withColumnRenamed("id", "unit_id").join(held.select("unit_id", "doc_id"), "unit_id").select("qid", "label", "unit_id", "doc_id", "score")
    # Questions with documents of their own meet the units of those alone.
    pairs = asked.where("size(doc_ids) > 0").withColumn("doc_id", F.explode(F.array_distinct("doc_ids"))).join(held, "doc_id")
    scored = pairs.select("qid", "label", "topk", "unit_id", "doc_id", F.round(retrieval.cosine(F.col("qvec"), F.col("vec")), 6).alias("score")).where("score > 0")
    inside = bm25.top_k(scored, ["qid", "label"], F.col("topk"), "unit_id").select("qid", "label", "unit_id", "doc_id", "score")
    return anywhere.unionByName(inside)


def number_hits(questions: DataFrame, units: DataFrame) -> DataFrame:
    """(qid, label 'number', unit_id, doc_id, score 1): units that hold one of the question's first numbers."""
    asked = questions.select("qid", "doc_ids", T.numbers(F.col("question"), T.QUERY_NUMBERS).alias("numbers"))
    chunks = units.select("doc_id", F.col("unit_id").alias("chunk_id"), T.numbers(F.col("text"), T.CHUNK_NUMBERS).alias("numbers"))
    found = retrieval.number_hits(asked, chunks).select("qid", F.col("chunk_id").alias("unit_id"), "doc_id", "score").distinct()
    return found.select("qid", F.lit("number").alias("label"), "unit_id", "doc_id", "score")


def card_hits(questions: DataFrame, units: DataFrame, method: Method, vocabulary: Vocabulary = CHINESE, strong: tuple[str, ...] = ()) -> DataFrame:
    """(qid, label 'card', unit_id, doc_id, score): domain cards that share a word with the question and score enough."""
    cards = S.domain_cards(units, vocabulary.card_patterns).join(units.select("doc_id", "ord", "unit_id"), ["doc_id", "ord"])
    words = lambda text: F.explode(F.array_distinct(T.card_tokens(text)))
    shared = questions.select("qid", words(F.col("question")).alias("w")).join(cards.select("unit_id", "card_type", words(F.col("text")).alias("w")), "w").select("qid", "unit_id", "card_type").distinct()
    rows = shared.join(cards, ["unit_id", "card_type"]).join(questions.select("qid", F.col("question").alias("query")), "qid")
    scored = rows.withColumn("score", scoring.card_score(F.col("query"), F.col("text"), F.col("card_type"), {}))
    good = allowed_pairs(search.strong_cards(scored, list(strong)).groupBy("qid", "unit_id", "doc_id").agg(F.max("score").alias("score")), questions)
    return bm25.top_k(good, ["qid"], method.card_k, "unit_id").select("qid", F.lit("card").alias("label"), "unit_id", "doc_id", "score")


def best_units(questions: DataFrame, units: DataFrame, method: Method, vocabulary: Vocabulary = CHINESE) -> DataFrame:
    """(qid, unit_id, doc_id, score, rank): merged hits, of routed sections if the method says so."""
    def merged(found: DataFrame) -> DataFrame:
        if method.dense:
            fused = search.hybrid_search(found, dense_hits(questions, units, method), "unit_id", method.stem_k, method.final_k)
            return fused.join(units.select("unit_id", "doc_id"), "unit_id").select("qid", "unit_id", "doc_id", "score", "rank")
        if method.numbers:
            found = found.unionByName(number_hits(questions, units))
        if method.cards:
            found = found.unionByName(card_hits(questions, units, method, vocabulary))
        if method.summed:
            return bm25.top_k(retrieval.add_scores(found, ["qid", "unit_id", "doc_id"]), ["qid"], method.final_k, "unit_id")
        return bm25.top_k(retrieval.merge_hits(found, ["qid", "unit_id", "doc_id"], method.bonus), ["qid"], method.final_k, "unit_id")

    if not method.routed:
        return merged(hits(questions, units, method, vocabulary=vocabulary))
    paths = units.groupBy("section_id").agg(F.min_by("text", "ord").alias("section_path"))
    chosen = materialise(route_sections(questions, units, paths, vocabulary), f"routes-{method.name}")
    inside = merged(hits(questions, units, method, vocabulary=vocabulary, sections=chosen))
    all_options = F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda o: o["value"]), " ")
    whole = questions.select("qid", F.lit("all").alias("label"), F.concat("question", F.lit("\n"), all_options).alias("query"), F.lit(method.final_k).cast("bigint").alias("topk"))
    return retrieval.with_fallback(materialise(inside, f"routed-{method.name}"), merged(hits(questions, units, method, whole, vocabulary)), questions, method.least_routed)


def evidence(questions: DataFrame, units: DataFrame, method: Method, vocabulary: Vocabulary = CHINESE) -> DataFrame:
    """(qid, evidence): rendered blocks in order of score within the budget."""
    if method.full_text:
        whole = S.full_text(units, "doc_id", "ord", "text")
        return questions.select("qid", F.explode("doc_ids").alias("doc_id")).join(whole, "doc_id").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "full_text"))), lambda x: x["full_text"]), "\n\n").alias("evidence"))
    # Read twice below: written once.
    found = materialise(best_units(questions, units, method, vocabulary), f"best-{method.name}")
    best = found.join(units.select("unit_id", "section_id", "text", "unit_type"), "unit_id")
    near = retrieval.siblings(best.select("qid", "unit_id", "section_id"), units, method.siblings).groupBy("qid", "unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.substring("text", 1, 220).alias("t")))), lambda x: x["t"]), "\n").alias("near"))
    block = T.render_fields([("doc", F.col("doc_id")), ("section", F.col("section_id")), ("text", F.col("text")), ("near", F.col("near"))], {"text": method.unit_chars})
    blocks = best.join(near, ["qid", "unit_id"], "left").withColumn("block", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]\n"), block))
    kept = retrieval.within_budget(blocks, "qid", ["rank"], F.length("block"), method.evidence_chars)
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("evidence"))


def prompts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Questions with their evidence as prompts; the instruction goes by answer format."""
    how: Column = F.when(F.col("answer_format") == "multi", "Choose every correct option.").when(F.col("answer_format") == "tf", "A is true, B is false.").otherwise("Choose one option.")
    body = F.concat_ws("\n\n", F.col("evidence"), F.col("question"), T.format_options(F.col("options")), how)
    return questions.join(found, "qid", "left").select("qid", "domain", "answer_format", "evidence", body.alias("prompt"))


def answer_questions(questions: DataFrame, units: DataFrame, method: Method, client, vocabulary: Vocabulary = CHINESE) -> DataFrame:
    """(qid, domain, answer_format, answer, raw_answer, evidence, prompt_tokens, completion_tokens)."""
    asked = materialise(prompts(questions, evidence(questions, units, method, vocabulary)), f"prompts-{method.name}")
    if method.votes > 1:
        asked = asked.select("*", F.explode(F.expr(f"sequence(1L, {method.votes}L)")).alias("round")).withColumn("prompt", F.concat("prompt", F.lit("\n#"), F.col("round").cast("string")))
    else:
        asked = asked.withColumn("round", F.lit(1).cast("bigint"))
    # Calls cost money: their results are written before they are read again.
    said = materialise(ask(asked, client), f"answers-{method.name}")
    said = said.withColumn("answer", or_default(normalize_answer(F.col("raw_answer"), F.col("answer_format"))))
    if method.votes > 1:
        voted = claims.option_vote(said.select("qid", "round", "answer")).withColumnRenamed("answer", "voted")
        totals = said.groupBy("qid", "domain", "answer_format").agg(F.min_by("raw_answer", "round").alias("raw_answer"), F.min_by("evidence", "round").alias("evidence"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
        first = totals.join(voted, "qid").withColumn("answer", F.col("voted")).drop("voted")
    else:
        first = said.drop("round", "prompt", "error").withColumn("confidence", F.lit(1.0))
    if not method.reflect:
        return _named(first)
    # A multiple choice with one letter, or an answer on which rounds disagree, is asked again; the longer answer counts.
    again = search.asks_again(first).select("qid").join(asked.where("round = 1"), "qid").withColumn("prompt", F.concat("prompt", F.lit("\nCheck every option again.")))
    second = materialise(ask(again.drop("round"), client), f"reflection-{method.name}")
    second = second.select("qid", normalize_answer(F.col("raw_answer"), F.col("answer_format")).alias("again"), F.col("prompt_tokens").alias("p2"), F.col("completion_tokens").alias("c2"))
    joined = first.join(second, "qid", "left").withColumn("answer", F.when(F.length("again") > F.length("answer"), F.col("again")).otherwise(F.col("answer")))
    return _named(joined.withColumn("prompt_tokens", F.col("prompt_tokens") + F.coalesce("p2", F.lit(0))).withColumn("completion_tokens", F.col("completion_tokens") + F.coalesce("c2", F.lit(0))))


def _named(df: DataFrame) -> DataFrame:
    return df.select("qid", "domain", "answer_format", "answer", "raw_answer", "evidence", "prompt_tokens", "completion_tokens")


def with_leads(options: DataFrame, vocabulary: Vocabulary, entity_words: list[str] = P.MULTI_ENTITY) -> DataFrame:
    """Options (qid, question, claim, doc_ids, ...) with what queries of the second round are made of: ``option_query``,
    ``metric_query`` (null: no metric to ask for), ``counter_query`` and ``searches``, array of (entity, query)."""
    company = F.get(T.named(F.concat_ws(" ", "claim", "question"), vocabulary.companies), F.lit(0))
    year = F.coalesce(P.first_year(F.col("claim")), P.first_year(F.col("question")))
    metrics = T.named(F.col("claim"), vocabulary.metrics)
    return options.select(
        "*", P.diversified_query(company, year, metrics, F.col("claim")).alias("option_query"), P.metric_query(company, year, metrics).alias("metric_query"),
        claims.counter_text(F.col("claim"), vocabulary.negations).alias("counter_query"), P.entity_queries(F.col("question"), F.col("claim"), F.col("doc_ids"), entity_words).alias("searches"),
    )


def action_queries(leads: DataFrame, actions: DataFrame, method: Method) -> DataFrame:
    """A query per action (qid, tool, option, entity): (qid, label, option, tool, query, topk, only)."""
    rows = actions.join(leads.select("qid", "option", "doc_ids", "option_query", "metric_query", "counter_query", "searches"), ["qid", "option"])
    own = F.get(F.filter("searches", lambda s: s["entity"] == F.col("entity")), F.lit(0))["query"]
    query = F.when(F.col("tool") == "counter_search", F.col("counter_query")).when(F.col("tool") == "metric_search", F.col("metric_query")).when(F.col("entity") != "", own).otherwise(F.col("option_query"))
    most = F.when(F.col("tool") == "counter_search", COUNTER_K).when(F.col("tool") == "metric_search", METRIC_K).otherwise(2 * method.option_k)
    only = F.when(F.array_contains(F.col("doc_ids").cast("array<string>"), F.col("entity")), F.col("entity"))
    return rows.select("qid", F.concat_ws("|", "option", "tool", "entity").alias("label"), "option", "tool", query.alias("query"), most.cast("bigint").alias("topk"), only.alias("only"))


def claim_workflow(questions: DataFrame, units: DataFrame, method: Method, client, most_calls: int = 12, vocabulary: Vocabulary = CHINESE) -> DataFrame:
    """Claim by claim: retrieve per option, verify, reflect, retrieve again for the actions, verify, aggregate.

    The second round runs each action's own query (option, metric, entity or counter-evidence) and adds what it finds to
    the option's facts of the first; counter-evidence is named as such.
    """
    from gleanery.functions.answers import verdict

    options = questions.select("qid", "answer_format", "question", "doc_ids", F.explode("options").alias("option", "claim"))
    found = hits(questions, units, method, vocabulary=vocabulary).join(units.select("unit_id", "text"), "unit_id")
    pooled = found.withColumn("option", F.when(F.col("label").startswith("option_"), F.substring("label", 8, 1)))
    facts = pooled.join(options.select("qid", F.col("option").alias("o")), "qid").where("option is null or option = o").groupBy("qid", F.col("o").alias("option")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("text")), 1, 20), "\n").alias("facts"))
    facts = materialise(facts, "facts-1")

    def verify(rows: DataFrame, name: str) -> DataFrame:
        asked = rows.withColumn("prompt", F.concat_ws("\n", "facts", "question", "claim", F.lit("supported, contradicted or mixed?")))
        said = materialise(ask(asked, client), name)
        status, confidence = verdict(F.col("raw_answer"))
        none = F.coalesce("facts", F.lit("")) == ""
        return said.select("qid", "answer_format", "option", "claim", "question", F.when(none, "mixed").otherwise(status).alias("status"), F.when(none, 0.0).otherwise(confidence).alias("confidence"))

    first = verify(options.join(facts, ["qid", "option"], "left"), "verify-1")
    calls = first.select("qid", F.lit("option_search").alias("tool"), "option")
    leads = with_leads(options, vocabulary)
    gaps = leads.select("qid", "option", F.col("metric_query").isNotNull().alias("measured"), F.transform("searches", lambda s: s["entity"]).alias("entities"))
    risky = first.withColumn("risky", F.col("claim").rlike("not|all|no |不|未|无|均|全部|所有|超过|低于")).join(gaps, ["qid", "option"])
    actions = materialise(claims.reflect(risky, calls, most_calls), "actions").select("qid", "tool", "option", "entity")
    queries = action_queries(leads, actions, method)
    more = hits(questions.join(actions.select("qid").distinct(), "qid", "left_semi"), units, method, queries.drop("option", "tool"), vocabulary)
    new = more.join(queries.select("qid", "label", "option", "tool"), ["qid", "label"]).join(units.select("unit_id", "text"), "unit_id")
    texts = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("text")))), "\n")
    counter = F.col("tool") == "counter_search"
    added = new.groupBy("qid", "option").agg(texts(~counter).alias("more"), texts(counter).alias("against"))
    told = F.array_join(F.filter(F.array("facts", "more", F.when(F.col("against") != "", F.concat(F.lit("Counter-evidence:\n"), F.col("against")))), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
    again = options.join(actions.select("qid", "option").distinct(), ["qid", "option"], "left_semi").join(facts, ["qid", "option"], "left").join(added, ["qid", "option"], "left")
    second = verify(again.withColumn("facts", told).drop("more", "against"), "verify-2")
    last = first.join(second.select("qid", "option"), ["qid", "option"], "left_anti").unionByName(second)
    return claims.aggregate_answers(last)


def route_sections(questions: DataFrame, units: DataFrame, sections: DataFrame, vocabulary: Vocabulary, client=None, candidates: int = 40, most: int = 5, most_multi: int = 10) -> DataFrame:
    """Sections (qid, doc_id, section_id, path, place) to search for each question.

    Candidates are sections hit by the stem or an option, by best score plus routing boost plus 1.1 per further
    query; a model may put the first ``candidates`` in order, else (or if it names none) the local order counts.
    """
    from gleanery.functions.answers import parse_selected

    found = hits(questions, units, METHODS["m07"].with_overrides(stem_k=candidates, option_k=candidates), vocabulary=vocabulary).join(units.select("unit_id", "section_id"), "unit_id")
    per = found.groupBy("qid", "doc_id", "section_id", "label").agg(F.max("score").alias("score"))
    named = per.join(sections.select("section_id", "section_path"), "section_id").join(questions.select("qid", "question", "domain", "answer_format"), "qid")
    boost = scoring.routing_boost(F.col("question"), F.col("section_path"), F.col("section_path"), F.col("domain"), vocabulary)
    merged = retrieval.merge_hits(named.withColumn("score", F.col("score") + boost), ["qid", "answer_format", "doc_id", "section_id", "section_path"], 1.1)
    best = bm25.top_k(merged, ["qid"], candidates, "doc_id", "section_id").select("qid", "answer_format", "doc_id", "section_id", F.col("section_path").alias("path"), F.col("rank").alias("place"))
    limit = F.when(F.col("answer_format") == "multi", most_multi).otherwise(most)
    if client is None:
        return best.where(F.col("place") <= limit).drop("answer_format")
    listed = materialise(best, "route-candidates")
    lines = listed.groupBy("qid").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x["path"])), "\n").alias("body"))
    said = materialise(ask(lines.join(questions.select("qid", "question"), "qid").select("qid", "n", F.concat_ws("\n", "question", "body", F.lit("Name sections as <<<n>>>.")).alias("prompt")), client), "route-answers")
    chosen = said.select("qid", F.posexplode(parse_selected(F.col("raw_answer"), F.col("n"))).alias("i", "place"))
    picked = listed.join(chosen, ["qid", "place"]).withColumn("place", (F.col("i") + 1).cast("bigint")).drop("i")
    rest = listed.join(chosen.select("qid").distinct(), "qid", "left_anti")
    return picked.unionByName(rest).where(F.col("place") <= limit).drop("answer_format")


#: Methods by name, for callers that add their own.
REGISTRY: dict[str, Method] = dict(METHODS)


def register(method: Method) -> Method:
    REGISTRY[method.name] = method
    return method
