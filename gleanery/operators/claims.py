"""Claims: risk flags, queries, evidence per option, reflection and final answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.answers import sanitize


def risk_flags(text: Column, risk: dict[str, list[str]]) -> Column:
    """``category:word`` for the first word of each category that the text holds."""
    def first(kind: str, words: list[str]) -> Column:
        out = F.lit(None).cast("string")
        for w in reversed(words):
            out = F.when(text.contains(w), F.lit(f"{kind}:{w}")).otherwise(out)
        return out

    return F.array_compact(F.array(*(first(k, w) for k, w in risk.items())))


def operation(flags: Column) -> Column:
    kinds = F.transform(flags, lambda f: F.substring_index(f, ":", 1))
    out = F.lit("lookup")
    for kind, name in (("negation", "negate"), ("universal", "universal"), ("comparison", "compare"), ("threshold", "threshold"), ("calculation", "calculate")):
        out = F.when(F.array_contains(kinds, kind), name).otherwise(out)
    return out


def counter_text(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The text with the first word of the list that it holds turned round, once."""
    out = text
    for word, other in reversed(pairs):
        at = F.instr(text, word)
        turned = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(other), F.substring(text, at + len(word), F.lit(1 << 30)))
        out = F.when(at > 0, turned).otherwise(out)
    return out


def evidence_groups(questions: DataFrame, global_k: int = 10, option_k: int = 10) -> DataFrame:
    """Questions (qid, question, options) as retrieval tasks: G01 for the stem, then one per option."""
    whole = questions.select("qid", F.lit("G01").alias("group_id"), F.lit("global").alias("mode"), F.col("question").alias("query"), F.array_sort(F.map_keys("options")).alias("covers"), F.lit(global_k).alias("topk"))
    each = questions.select("qid", "question", F.posexplode(F.array_sort(F.map_entries("options"))).alias("i", "o"))
    rows = each.select("qid", F.format_string("G%02d", F.col("i") + 2).alias("group_id"), F.lit("option").alias("mode"), F.concat("question", F.lit("\n"), F.col("o.key"), F.lit(". "), F.col("o.value")).alias("query"), F.array("o.key").alias("covers"), F.lit(option_k).alias("topk"))
    return whole.unionByName(rows)


def facts_per_option(evidence: DataFrame) -> DataFrame:
    """Pooled evidence (qid, evidence_id, covers, score, content) dealt to the options it covers, best first."""
    rows = evidence.select("qid", F.explode("covers").alias("option"), F.struct((-F.col("score")).alias("s"), "evidence_id", "content").alias("e"))
    return rows.groupBy("qid", "option").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["content"]).alias("facts"), F.count("*").alias("n_facts"))


def aggregate_answers(claims: DataFrame) -> DataFrame:
    """Claims (qid, answer_format, option, status, confidence) to one answer per question."""
    high = (F.col("status") == "mixed") & (F.col("confidence") >= 0.6)
    some = (F.col("status") == "mixed") & (F.col("confidence") >= 0.4)
    order = Window.partitionBy("qid").orderBy(F.when(some, F.col("confidence")).desc_nulls_last(), "option")
    rows = claims.withColumn("__n", F.row_number().over(order))
    letters = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("option")))), "")
    best = lambda cond: F.max_by(F.when(cond, F.col("option")), F.when(cond, F.struct("confidence", (-F.ascii("option")).alias("o"))))
    is_ = lambda o, s: F.max(F.when((F.col("option") == o) & (F.col("status") == s), 1).otherwise(0)) == 1
    level = lambda o: F.max(F.when(F.col("option") == o, F.col("confidence")))
    got = rows.groupBy("qid", "answer_format").agg(
        letters((F.col("status") == "supported") | high).alias("chosen"),
        letters(some & (F.col("__n") <= 3)).alias("fallback"),
        best(F.col("status") == "supported").alias("one"),
        best(F.col("status") != "contradicted").alias("other"),
        *(is_(o, s).alias(f"{o}_{s}") for o in "AB" for s in ("supported", "contradicted")),
        level("A").alias("a"), level("B").alias("b"),
    )
    multi = F.coalesce(F.nullif("chosen", F.lit("")), F.nullif("fallback", F.lit("")), F.lit("A"))
    mcq = F.coalesce("one", "other", F.lit("A"))
    tf = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "A")
        .when(F.col("A_supported") & ~F.col("B_supported"), "A").when(F.col("B_supported") & ~F.col("A_supported"), "B")
        .when(F.col("A_contradicted"), "B").when(F.col("B_contradicted"), "A").when(F.col("a") >= F.col("b"), "A").otherwise("B")
    )
    answer = F.when(F.col("answer_format") == "multi", multi).when(F.col("answer_format") == "tf", tf).otherwise(mcq)
    return got.select("qid", "answer_format", sanitize(answer, F.col("answer_format")).alias("answer"))


def reflect(claims: DataFrame, calls: DataFrame, most_calls: int = 12) -> DataFrame:
    """Actions of the second round for claims (qid, answer_format, option, status, confidence, risky, and perhaps
    measured: has a metric query; entities: array of names) and the log of calls so far (qid, tool, option):
    (qid, tool, option, entity, place).

    Rules: multi without a supported option searches the three weakest mixed ones again, with one supported
    the others unless they are surely contradicted, by option, metric and entity; mcq with several supported
    looks for counter-evidence; options that stay unclear get their own searches, those with risky words
    counter-evidence once. Each (tool, option, entity) once; all within what is left of ``most_calls``.
    """
    for name, other in (("measured", F.lit(False)), ("entities", F.array().cast("array<string>"))):
        if name not in claims.columns:
            claims = claims.withColumn(name, other)
    c = claims.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("option")))
    per = Window.partitionBy("qid")
    c = c.withColumn("supported", F.sum((F.col("status") == "supported").cast("int")).over(per)).withColumn("open", F.sum((F.col("status") == "mixed").cast("int")).over(per))
    low = (F.col("status") == "mixed") & (F.col("confidence") < 0.4)
    c = c.withColumn("low_n", F.sum(low.cast("int")).over(per.orderBy("rank")))
    candidate = F.when(F.col("open") > 0, F.col("status") == "mixed").otherwise(F.col("status") == "contradicted")
    c = c.withColumn("cand_n", F.sum(candidate.cast("int")).over(per.orderBy("rank")))
    multi = F.col("answer_format") == "multi"
    none = multi & (F.col("supported") == 0) & low & (F.col("low_n") <= 3)
    single = multi & (F.col("supported") == 1) & candidate & (F.col("cand_n") <= 3) & ~((F.col("status") == "contradicted") & (F.col("confidence") >= 0.92))
    several = (F.col("answer_format") == "mcq") & (F.col("supported") > 1) & (F.col("status") == "supported")
    skip = ((F.col("status") == "contradicted") & (F.col("confidence") > 0.85)) | ((F.col("status") == "supported") & (F.col("confidence") > 0.8) & ~F.col("risky"))
    unclear = ~skip & (F.col("status") == "mixed") & (F.col("confidence") < 0.5)
    counter = ~skip & F.col("risky")
    done = calls.where("tool = 'counter_search'").select("qid", "option", F.lit(True).alias("countered")).distinct()
    c = c.join(done, ["qid", "option"], "left").withColumn("countered", F.coalesce("countered", F.lit(False)))

    def action(when: Column, tool: str, phase: int, step: int) -> Column:
        at = F.struct(F.lit(phase).alias("p"), F.col("rank").alias("r"), F.lit(step).alias("s"), F.lit(0).alias("i"))
        return F.when(when, F.array(F.struct(F.lit(tool).alias("tool"), F.lit("").alias("entity"), at.alias("at"))))

    def each_entity(when: Column, phase: int) -> Column:
        at = lambda i: F.struct(F.lit(phase).alias("p"), F.col("rank").alias("r"), F.lit(2).alias("s"), (i + 1).alias("i"))
        return F.when(when, F.transform("entities", lambda e, i: F.struct(F.lit("option_search").alias("tool"), e.alias("entity"), at(i).alias("at"))))

    wanted = F.flatten(F.array_compact(F.array(
        action(none | single, "option_search", 0, 0), action((none | single) & F.col("measured"), "metric_search", 0, 1), each_entity(single, 0),
        action(several, "counter_search", 0, 3),
        action(unclear, "option_search", 1, 0), action(unclear & F.col("measured"), "metric_search", 1, 1), each_entity(unclear, 1),
        action(counter & ~F.col("countered"), "counter_search", 1, 3),
    )))
    rows = c.select("qid", "option", F.explode(wanted).alias("w")).groupBy("qid", "option", "w.tool", "w.entity").agg(F.min("w.at").alias("at"))
    used = calls.groupBy("qid").agg(F.count("*").alias("used"))
    n = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    left = F.greatest(F.lit(0), F.lit(most_calls) - F.coalesce("used", F.lit(0)))
    return rows.withColumn("place", n.cast("bigint")).join(used, "qid", "left").where(F.col("place") <= left).select("qid", "tool", "option", "entity", "place")


def majority(votes: DataFrame) -> DataFrame:
    """Votes (qid, round, answer): the most frequent, on a tie the one seen first."""
    per = votes.groupBy("qid", "answer").agg(F.count("*").alias("n"), F.min("round").alias("first"))
    return per.groupBy("qid").agg(F.min_by("answer", F.struct((-F.col("n")).alias("n"), "first")).alias("answer"), F.sum("n").alias("rounds"), F.max("n").alias("votes"))


def option_vote(votes: DataFrame) -> DataFrame:
    """Votes (qid, round, answer of letters): every option in at least half of the rounds, with the mean share;
    without one the majority answer at 0.5."""
    rounds = votes.groupBy("qid").agg(F.count("*").alias("rounds"))
    letters = votes.select("qid", F.explode(F.filter(F.array_distinct(F.split("answer", "")), lambda c: c != "")).alias("option"))
    share = letters.groupBy("qid", "option").agg(F.count("*").alias("n")).join(rounds, "qid").withColumn("share", F.col("n") / F.col("rounds"))
    chosen = share.where("share >= 0.5").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("option")), "").alias("picked"), F.avg("share").alias("mean"))
    return majority(votes).join(chosen, "qid", "left").select("qid", F.coalesce("picked", "answer").alias("answer"), F.round(F.coalesce("mean", F.lit(0.5)), 4).alias("confidence"))
