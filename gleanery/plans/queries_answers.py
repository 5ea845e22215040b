"""Queries over answers, claims, votes, evaluation and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import answers as A
from gleanery.functions.vocab import TOKEN_BUDGET
from gleanery.operators import claims as C
from gleanery.operators import evaluation as E
from gleanery.plans import inputs as I
from gleanery.plans.registry import query
from gleanery.session import table

#: Shapes of raw model output around a turn's text, by turn.
FRAMES = ("最终答案：{}", "选{}", "答案是{}\n理由很长很长很长很长很长很长很长很长很长", "{}", "综上，答案为{}", "ERROR {}", "分析如下，正确答案：{}\nthis closing line is long enough to pass on", "x\n{}\n")
_LETTERS = "substr('ABCDA', CAST(1 + length(text) % 4 AS INT), CAST(1 + length(text) % 2 AS INT))"


def _frame_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN concat({', '.join(f'$q${p}$q$' for p in f.split('{}')[:1])}, {_LETTERS}, $q${f.split('{}')[1]}$q$)" for i, f in enumerate(FRAMES))
    return f"CASE (turn + length(text)) % {len(FRAMES)} {cases} END"


RAW_CTE = f"raw AS (SELECT conv_id * 1000 + turn AS qid, CASE conv_id % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'mcq' ELSE 'tf' END AS kind, {_frame_sql()} AS raw FROM conversations)"


def raw_answers(spark: SparkSession, d: str) -> DataFrame:
    letters = F.substring(F.lit("ABCDA"), (1 + F.length("text") % 4).cast("int"), (1 + F.length("text") % 2).cast("int"))
    out = F.lit(None).cast("string")
    for i, f in enumerate(FRAMES):
        before, after = f.split("{}")
        out = F.when((F.col("turn") + F.length("text")) % len(FRAMES) == i, F.concat(F.lit(before), letters, F.lit(after))).otherwise(out)
    kind = F.when(F.col("conv_id") % 3 == 0, "multi").when(F.col("conv_id") % 3 == 1, "mcq").otherwise("tf")
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), kind.alias("kind"), out.alias("raw"))


def _shape_sql(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN 'A' WHEN kind = 'tf' THEN coalesce(list_filter({x}, lambda c: c IN ('A', 'B'))[1], 'A') WHEN kind = 'multi' THEN array_to_string(list_sort(list_distinct({x})), '') ELSE {x}[1] END"


def _letters_sql(x: str) -> str:
    return f"regexp_extract_all(upper({x}), '[A-D]')"


def _normal_sql(patterns: tuple[str, ...], lines: int, short_line: int, short_text: int | None, fold: bool) -> str:
    parts = []
    for k in range(1, lines + 1):
        line = f"trim(coalesce(parts[-{k}], ''))"
        parts.append(f"CASE WHEN len(parts) >= {k} AND len({_letters_sql(line)}) > 0 AND length({line}) < {short_line} THEN {_shape_sql(_letters_sql(line))} END")
    for p in patterns:
        got = f"regexp_extract({'upper(raw)' if fold else 'raw'}, '{p}', 1)"
        parts.append(f"CASE WHEN {got} <> '' THEN {_shape_sql(_letters_sql(got))} END")
    if short_text:
        parts.append(f"CASE WHEN length(clean) < {short_text} AND len({_letters_sql('clean')}) > 0 THEN {_shape_sql(_letters_sql('clean'))} END")
    found = _letters_sql("CASE WHEN len(parts) >= 5 THEN array_to_string(parts[-5:], chr(10)) ELSE raw END")
    end = f"CASE kind WHEN 'mcq' THEN {found}[-1] WHEN 'tf' THEN coalesce(list_filter({found}, lambda c: c IN ('A', 'B'))[-1], 'A') ELSE array_to_string(list_sort(list_distinct({found})), '') END"
    parts.append(f"CASE WHEN len({found}) > 0 THEN {end} END")
    return f"CASE WHEN raw = '' OR starts_with(raw, 'ERROR') THEN 'A' ELSE coalesce({', '.join(parts)}, 'A') END"


CLEAN_CTE = RAW_CTE + ", c AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS clean FROM raw), n AS (SELECT *, string_split(clean, chr(10)) AS parts FROM c)"


@query(f"WITH {CLEAN_CTE} SELECT qid, {_normal_sql(A.ANSWER_PATTERNS, 3, 15, 20, True)} AS answer FROM n")
def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return raw_answers(spark, d).select("qid", A.normalize_answer(F.col("raw"), F.col("kind")).alias("answer"))


@query(f"WITH {CLEAN_CTE} SELECT qid, {_normal_sql(A.ANSWER_PATTERNS, 3, 15, None, False)} AS answer FROM n")
def normalize_answer_strict(spark: SparkSession, d: str) -> DataFrame:
    """Patterns without folding, and no step for short texts."""
    return raw_answers(spark, d).select("qid", A.normalize_answer(F.col("raw"), F.col("kind"), short_text=None, fold=False).alias("answer"))


@query(f"WITH {CLEAN_CTE} SELECT qid, {_normal_sql(A.FIELD_PATTERNS, 5, 20, None, False)} AS answer FROM n")
def field_answer(spark: SparkSession, d: str) -> DataFrame:
    return raw_answers(spark, d).select("qid", A.field_answer(F.col("raw"), F.col("kind")).alias("answer"))


_EXTRACT = "CASE WHEN length(t) < 20 AND len(regexp_extract_all(t, '[A-D]')) > 0 THEN regexp_extract_all(t, '[A-D]') ELSE coalesce(" + ", ".join(f"nullif(regexp_extract_all(regexp_extract(t, '{p}', 1), '[A-D]'), []::VARCHAR[])" for p in A.LETTER_PATTERNS) + ", regexp_extract_all(t, '[A-D]')) END"


@query(f"WITH {RAW_CTE}, t AS (SELECT qid, upper(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) AS t FROM raw) SELECT qid, array_to_string({_EXTRACT}, '') AS letters FROM t")
def extract_letters(spark: SparkSession, d: str) -> DataFrame:
    return raw_answers(spark, d).select("qid", F.array_join(A.extract_letters(F.col("raw")), "").alias("letters"))


@query(f"WITH {RAW_CTE}, f AS (SELECT qid, kind, list_sort(list_distinct({_letters_sql('raw')})) AS l FROM raw) SELECT qid, CASE WHEN len(l) = 0 THEN 'A' WHEN kind = 'mcq' THEN l[1] WHEN kind = 'tf' THEN coalesce(list_filter(l, lambda c: c IN ('A', 'B'))[1], 'A') ELSE array_to_string(l, '') END AS answer FROM f")
def sanitize_answer(spark: SparkSession, d: str) -> DataFrame:
    return raw_answers(spark, d).select("qid", A.sanitize(F.col("raw"), F.col("kind")).alias("answer"))


@query("""WITH s AS (SELECT conv_id, turn, concat('pick <<<', turn + 1, '>>> and <<<', length(text) % 12, '>>> or 7') AS a, concat(turn + 1, ', ', length(text) % 12, ' and 77') AS b FROM conversations),
l AS (SELECT conv_id * 1000 + turn AS qid, [turn + 1, CASE WHEN length(split_part(a, '<<<', 3)) > 0 THEN CAST(regexp_extract(a, 'and <<<([0-9]+)>>>', 1) AS BIGINT) END] AS n FROM s)
SELECT qid, array_to_string(list_filter(CASE WHEN n[1] = n[2] THEN [n[1]] ELSE n END, lambda x: x BETWEEN 1 AND 10), ',') AS marked, array_to_string(list_filter(CASE WHEN n[1] = n[2] THEN [n[1]] ELSE n END, lambda x: x BETWEEN 1 AND 10), ',') AS loose FROM l""")
def selected_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    n, m = F.col("turn") + 1, F.length("text") % 12
    marked = F.concat(F.lit("pick <<<"), n, F.lit(">>> and <<<"), m, F.lit(">>> or 7"))
    loose = F.concat(n.cast("string"), F.lit(", "), m, F.lit(" and 77"))
    shown = lambda t: F.array_join(F.transform(A.parse_selected(t, F.lit(10)), lambda x: x.cast("string")), ",")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), shown(marked).alias("marked"), shown(loose).alias("loose"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'mixed' WHEN 3 THEN 'supported' ELSE 'mixed' END AS status,
  CASE WHEN event_id % 5 IN (0, 1, 2) THEN (event_id % 10) / 10.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM events""")
def json_verdict(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("event_id") % 5, (F.col("event_id") % 10 / 10).cast("string")
    body = F.concat(F.lit('{"status": "'), F.when(k == 0, "supported").when(k == 1, "Contradicted").otherwise("insufficient"), F.lit('", "confidence": '), c, F.lit("}"))
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here: "), body, F.lit(" ok"))).when(k == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 3, "clearly SUPPORTED by the text").otherwise("no idea")
    status, confidence = A.verdict(raw)
    return table(spark, d, "events").select("event_id", status.alias("status"), confidence.alias("confidence"))


MAJORITY_CTE = I.VOTES_CTE + """, per AS (SELECT qid, answer, count(*) AS n, min(round) AS first FROM votes GROUP BY ALL),
major AS (SELECT qid, first(answer ORDER BY n DESC, first) AS answer, CAST(sum(n) AS BIGINT) AS rounds, max(n) AS votes FROM per GROUP BY qid)"""


@query(f"WITH {MAJORITY_CTE} SELECT * FROM major")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return C.majority(I.votes(spark, d))


@query(f"""WITH {MAJORITY_CTE}, s AS (SELECT qid, option, count(*) / any_value(rounds)::DOUBLE AS share FROM (SELECT qid, unnest(list_distinct(regexp_extract_all(answer, '[A-D]'))) AS option FROM votes) JOIN major USING (qid) GROUP BY qid, option),
p AS (SELECT qid, string_agg(option, '' ORDER BY option) AS picked, avg(share) AS mean FROM s WHERE share >= 0.5 GROUP BY qid)
SELECT qid, coalesce(picked, answer) AS answer, round(coalesce(mean, 0.5), 4) AS confidence FROM major LEFT JOIN p USING (qid)""")
def option_vote(spark: SparkSession, d: str) -> DataFrame:
    return C.option_vote(I.votes(spark, d))


_AGG = f"""WITH {I.CLAIMS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN status = 'mixed' AND confidence >= 0.4 THEN confidence END DESC NULLS LAST, option) AS k FROM claims WHERE answer_format = '{{}}')"""


@query(_AGG.format("multi") + """ SELECT qid, coalesce(string_agg(option, '' ORDER BY option) FILTER (status = 'supported' OR (status = 'mixed' AND confidence >= 0.6)),
  string_agg(option, '' ORDER BY option) FILTER (status = 'mixed' AND confidence >= 0.4 AND k <= 3), 'A') AS answer FROM r GROUP BY qid""")
def aggregate_multi(spark: SparkSession, d: str) -> DataFrame:
    return C.aggregate_answers(I.claims(spark, d)).where("answer_format = 'multi'").select("qid", "answer")


@query(_AGG.format("mcq") + """ SELECT qid, coalesce(first(option ORDER BY confidence DESC, option) FILTER (status = 'supported'), first(option ORDER BY confidence DESC, option) FILTER (status <> 'contradicted'), 'A') AS answer FROM r GROUP BY qid""")
def aggregate_mcq(spark: SparkSession, d: str) -> DataFrame:
    return C.aggregate_answers(I.claims(spark, d)).where("answer_format = 'mcq'").select("qid", "answer")


@query(_AGG.format("tf") + """, p AS (SELECT qid, max(status) FILTER (option = 'A') AS sa, max(status) FILTER (option = 'B') AS sb, max(confidence) FILTER (option = 'A') AS ca, max(confidence) FILTER (option = 'B') AS cb FROM r GROUP BY qid)
SELECT qid, CASE WHEN sa IS NULL OR sb IS NULL THEN 'A' WHEN sa = 'supported' AND sb <> 'supported' THEN 'A' WHEN sb = 'supported' AND sa <> 'supported' THEN 'B' WHEN sa = 'contradicted' THEN 'B' WHEN sb = 'contradicted' THEN 'A' WHEN ca >= cb THEN 'A' ELSE 'B' END AS answer FROM p""")
def aggregate_tf(spark: SparkSession, d: str) -> DataFrame:
    return C.aggregate_answers(I.claims(spark, d)).where("answer_format = 'tf'").select("qid", "answer")


@query(f"""WITH {I.CLAIMS_CTE}, calls AS (SELECT doc_id // 4 AS qid, 'counter_search' AS tool, substr('ABCD', CAST(doc_id % 4 + 1 AS INT), 1) AS option FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id // 4, 'option_search', 'A' FROM documents, range(11) WHERE doc_id % 40 = 0),
c AS (SELECT *, length(text) % 3 = 0 AS doc_measured, row_number() OVER w AS rank, sum(CASE WHEN status = 'supported' THEN 1 ELSE 0 END) OVER p AS supported, sum(CASE WHEN status = 'mixed' THEN 1 ELSE 0 END) OVER p AS open FROM claims WINDOW w AS (PARTITION BY qid ORDER BY option), p AS (PARTITION BY qid)),
c2 AS (SELECT *, status = 'mixed' AND confidence < 0.4 AS low, CASE WHEN open > 0 THEN status = 'mixed' ELSE status = 'contradicted' END AS cand FROM c),
c3 AS (SELECT *, sum(CAST(low AS INT)) OVER w AS low_n, sum(CAST(cand AS INT)) OVER w AS cand_n, (status = 'contradicted' AND confidence > 0.85) OR (status = 'supported' AND confidence > 0.8 AND NOT risky) AS skip,
  EXISTS (SELECT 1 FROM calls k WHERE k.tool = 'counter_search' AND k.qid = c2.qid AND k.option = c2.option) AS countered FROM c2 WINDOW w AS (PARTITION BY qid ORDER BY option)),
x AS (SELECT *, doc_measured AS measured, answer_format = 'multi' AND supported = 0 AND low AND low_n <= 3 AS none_, answer_format = 'multi' AND supported = 1 AND cand AND cand_n <= 3 AND NOT (status = 'contradicted' AND confidence >= 0.92) AS single,
  NOT skip AND status = 'mixed' AND confidence < 0.5 AS unclear FROM c3),
a AS (
  SELECT qid, option, 'option_search' AS tool, '' AS entity, 0 AS p, rank, 0 AS s, 0 AS i FROM x WHERE none_ OR single
  UNION ALL SELECT qid, option, 'metric_search', '', 0, rank, 1, 0 FROM x WHERE (none_ OR single) AND measured
  UNION ALL SELECT qid, option, 'option_search', e.name, 0, rank, 2, e.i FROM x, (VALUES ('d1', 1), ('d2', 2)) AS e(name, i) WHERE single AND measured
  UNION ALL SELECT qid, option, 'counter_search', '', 0, rank, 3, 0 FROM x WHERE answer_format = 'mcq' AND supported > 1 AND status = 'supported'
  UNION ALL SELECT qid, option, 'option_search', '', 1, rank, 0, 0 FROM x WHERE unclear
  UNION ALL SELECT qid, option, 'metric_search', '', 1, rank, 1, 0 FROM x WHERE unclear AND measured
  UNION ALL SELECT qid, option, 'option_search', e.name, 1, rank, 2, e.i FROM x, (VALUES ('d1', 1), ('d2', 2)) AS e(name, i) WHERE unclear AND measured
  UNION ALL SELECT qid, option, 'counter_search', '', 1, rank, 3, 0 FROM x WHERE NOT skip AND risky AND NOT countered),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, option, tool, entity ORDER BY p, rank, s, i) AS k FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p, rank, s, i) AS place FROM o WHERE k = 1)
SELECT n.qid, n.tool, n.option, n.entity, n.place FROM n LEFT JOIN (SELECT qid, count(*) AS used FROM calls GROUP BY qid) u USING (qid) WHERE place <= greatest(0, 12 - coalesce(used, 0))""")
def reflect_actions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 4").alias("qid"))
    option = F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1))
    some = docs.where("doc_id % 5 = 0").select("qid", F.lit("counter_search").alias("tool"), option.alias("option"))
    many = docs.where("doc_id % 40 = 0").select("qid", F.lit("option_search").alias("tool"), F.lit("A").alias("option"), F.explode(F.sequence(F.lit(0), F.lit(10)))).drop("col")
    measured = F.length("text") % 3 == 0
    entities = F.when(measured, F.array(F.lit("d1"), F.lit("d2"))).otherwise(F.array().cast("array<string>"))
    return C.reflect(I.claims(spark, d).withColumn("measured", measured).withColumn("entities", entities), some.unionByName(many))


@query(f"""WITH {I.Q_CTE}
SELECT qid, 'G01' AS group_id, 'global' AS mode, question AS query, 'A,B,C,D' AS covers, 10 AS topk FROM questions
UNION ALL SELECT qid, concat('G0', ascii(option) - 63), 'option', concat(question, chr(10), option, '. ', body), option, 10 FROM options""")
def evidence_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.evidence_groups(I.questions(spark, d)).withColumn("covers", F.array_join("covers", ","))


@query(f"""WITH {I.CLAIMS_CTE}, e AS (SELECT qid, option, text, confidence FROM claims)
SELECT qid, option, md5(string_agg(text, '|' ORDER BY confidence DESC, text)) AS facts, count(*) AS n_facts FROM (
  SELECT e.qid, o.option, e.text, e.confidence FROM e, (VALUES ('A'), ('B')) AS o(option) WHERE e.option >= o.option) GROUP BY qid, option""")
def facts_per_option(spark: SparkSession, d: str) -> DataFrame:
    rows = I.claims(spark, d).select("qid", F.col("text").alias("evidence_id"), F.filter(F.array(F.lit("A"), F.lit("B")), lambda o: F.col("option") >= o).alias("covers"), F.col("confidence").alias("score"), F.col("text").alias("content"))
    return C.facts_per_option(rows).select("qid", "option", F.md5(F.array_join("facts", "|")).alias("facts"), "n_facts")


@query(f"WITH {I.PRED_CTE} SELECT p.qid, p.domain, p.answer, g.answer AS gold, p.answer = g.answer AS correct FROM predicted p JOIN gold g USING (qid)")
def compare_answers(spark: SparkSession, d: str) -> DataFrame:
    return E.compare(*I.predictions(spark, d))


@query(f"WITH {I.PRED_CTE} SELECT domain, count(*) AS n, count(*) FILTER (p.answer = g.answer) AS n_right, round(count(*) FILTER (p.answer = g.answer) / count(*)::DOUBLE, 4) AS accuracy FROM predicted p JOIN gold g USING (qid) GROUP BY ROLLUP (domain)")
def accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    return E.accuracy(E.compare(*I.predictions(spark, d)), "domain")


@query(f"""WITH {I.RESULTS_CTE} SELECT n, prompt_tokens, completion_tokens, total_tokens, round(s, 6) AS token_score, round(0.7 + 0.3 * s, 6) AS multiplier FROM (
  SELECT *, CASE WHEN total_tokens <= 0 THEN 0 ELSE greatest(0, least(1, ({TOKEN_BUDGET} - total_tokens) / {TOKEN_BUDGET}::DOUBLE)) END AS s FROM (
    SELECT count(*) AS n, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM results))""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.run_summary(I.results(spark, d), TOKEN_BUDGET)


@query(f"WITH {I.RESULTS_CTE} SELECT domain, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(total_tokens) AS BIGINT) // count(*) AS average FROM results GROUP BY domain")
def domain_stats(spark: SparkSession, d: str) -> DataFrame:
    return E.domain_stats(I.results(spark, d), "domain", "total_tokens")


@query(f"""WITH {I.RESULTS_CTE} SELECT CAST(qid AS VARCHAR) AS qid, answer, prompt_tokens, completion_tokens, total_tokens, 1::BIGINT AS place FROM results
UNION ALL SELECT 'summary', '', CAST(sum(prompt_tokens) AS BIGINT), CAST(sum(completion_tokens) AS BIGINT), CAST(sum(total_tokens) AS BIGINT), 0 FROM results""")
def answer_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return E.answer_rows(I.results(spark, d).withColumn("qid", F.col("qid").cast("string")))


@query(f"WITH {I.UNITS_CTE} SELECT unit_type, count(*) AS n FROM units GROUP BY unit_type")
def unit_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return E.histogram(I.units(spark, d), "unit_type")


@query("""SELECT doc_id AS qid, CASE WHEN quality IS NOT NULL THEN CAST(quality AS VARCHAR) ELSE 'none' END AS answer, lang FROM documents d LEFT JOIN labels l USING (doc_id)""")
def gold_union_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Gold labels replace default answers of the same id; what else the default knew is looked up again."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.lit("none").alias("answer"), "lang")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").cast("string").alias("answer"))
    return E.last_wins([docs.select("qid", "answer"), labels], "qid").join(docs.select("qid", "lang"), "qid", "left").select("qid", "answer", "lang")


@query("SELECT doc_id AS qid, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_antijoin(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "lang")
    return E.pending(wanted, table(spark, d, "labels").select(F.col("doc_id").alias("qid")))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('new/', doc_id) ELSE concat('old/', doc_id) END AS path FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("old/"), "doc_id").alias("path"))
    new = docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("new/"), "doc_id").alias("path"))
    return E.last_wins([old, new], "doc_id")


@query("""SELECT DISTINCT o_custkey AS doc_id FROM orders UNION SELECT c_custkey FROM customer""")
def wanted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Ids that questions name, together with those on disk."""
    named = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.collect_set("o_custkey").alias("doc_ids"))
    return named.select(F.explode("doc_ids").alias("doc_id")).union(table(spark, d, "customer").select("c_custkey")).distinct()


@query("""SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels""")
def common_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("""SELECT qid, regexp_extract(raw, 'x', 0) AS marked, substr(sha256(concat('{"k":', qid, '}')), 1, 12) AS config_hash FROM (SELECT event_id AS qid, event_type AS raw FROM events)""")
def config_hash(spark: SparkSession, d: str) -> DataFrame:
    """First twelve digits of the hash of a configuration's JSON."""
    json = F.to_json(F.struct(F.col("event_id").alias("k")))
    return table(spark, d, "events").select(F.col("event_id").alias("qid"), F.regexp_extract("event_type", "x", 0).alias("marked"), F.substring(F.sha2(json, 256), 1, 12).alias("config_hash"))
