"""Queries over planning functions, line parsers and item-level diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import planning as P
from gleanery.functions import text as T
from gleanery.functions.vocab import LATIN
from gleanery.operators import bm25, evaluation, parsing, retrieval
from gleanery.plans import inputs as I
from gleanery.plans.queries_index import DOCS, ITEMS, bm25_sql
from gleanery.plans.queries_text import proxy_sql
from gleanery.plans.registry import query
from gleanery.session import table

#: Fixed texts on which Chinese rules act; row n of a table gets text n modulo their number.
TEXTS = (
    "以下关于某保险公司的说法，正确的是？", "哪些公司的净利润超过10亿", "2023年比例是多少", "比较两者的区别", "发行金额不超过10亿元，赎回条款与信息披露",
    "机构应当在10个工作日内提交，免赔额为100元", "单位：万元 2024年1,234.5", "表3：主要指标情况\n其他", "最终答案：**A、C**", "答案为：B\n最终答案是：D 最终答案：CA", "净利润、违约与罚息", "plain words only",
)
_V = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TEXTS)) + ") AS v(i, text)"
TEXTS_CTE = f"texts AS (SELECT o_orderkey AS id, v.text FROM orders JOIN {_V.replace(chr(10), '` || chr(10) || `')} ON v.i = o_orderkey % {len(TEXTS)})".replace("`", "'")


def texts(spark: SparkSession, d: str) -> DataFrame:
    held = F.array(*map(F.lit, TEXTS))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.get(held, (F.col("o_orderkey") % len(TEXTS)).cast("int")).alias("text"))


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


@query(f"WITH {TEXTS_CTE} SELECT id, CASE WHEN contains(text, '以下') AND {_has(['正确', '错误'])} THEN 'option_verification' WHEN {_has(['哪', '属于'])} THEN 'selection' WHEN {_has(['计算', '多少', '金额', '比例'])} THEN 'calculation' WHEN {_has(['比较', '对比', '区别'])} THEN 'comparison' ELSE 'factual' END AS kind FROM texts")
def question_type(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", P.question_type(F.col("text")).alias("kind"))


@query(f"WITH {TEXTS_CTE} SELECT id, nullif(regexp_extract(text, '{P.COMPANY}', 1), '') AS company, CAST(nullif(regexp_extract(text, '20[12][0-9]', 0), '') AS BIGINT) AS year FROM texts")
def company_and_year(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", P.first_company(F.col("text")).alias("company"), P.first_year(F.col("text")).alias("year"))


_L = [f"array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_extract_all(text, '{p}', 1)[-1], '[A-D]'))), '')" for p in P.LAST_ANSWER]


@query(f"WITH {TEXTS_CTE} SELECT id, CASE " + " ".join(f"WHEN len(regexp_extract_all(text, '{p}', 1)) > 0 THEN {x}" for p, x in zip(P.LAST_ANSWER, _L)) + " ELSE '' END AS answer FROM texts")
def last_answer(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", P.last_answer(F.col("text")).alias("answer"))


@query(f"WITH {TEXTS_CTE} SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '20[0-9]{{2}}'))), ',') AS years, array_to_string(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%?|[0-9]+(?:,[0-9]{{3}})+(?:\\.[0-9]+)?')[1:12], ',') AS numbers,"
       f" CASE WHEN contains(text, '应当') THEN '应当' WHEN contains(text, '不得') THEN '不得' WHEN contains(text, '可以') THEN '可以' END AS modal, nullif(replace(regexp_extract(text, '{P.DEADLINE}', 1), ' ', ''), '') AS deadline,"
       f" nullif(regexp_extract(text, '{P.RULE_KEY}', 1), '') AS rule_key, nullif(regexp_extract(text, '{P.RULE_KEY}', 2), '') AS rule_value FROM texts")
def structured_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select("id", P.structured_fields(F.col("text")).alias("s")).select("id", "s.*")
    return rows.withColumn("years", F.array_join("years", ",")).withColumn("numbers", F.array_join("numbers", ","))


@query(f"WITH {TEXTS_CTE} SELECT id, coalesce({', '.join(f'''nullif(regexp_extract(text, '{p}', 1), '')''' for p in P.UNIT_PATTERNS)}) AS unit,"
       " coalesce(nullif(trim(regexp_extract(text, '表\\s*[0-9]+[:：]?([^\\n]{2,40})', 1)), ''), nullif(trim(regexp_extract(text, '([\\x{4e00}-\\x{9fff}]{2,30}(?:表|指标|情况|明细))', 1)), ''), CASE WHEN id % 2 = 0 THEN 'B' ELSE concat('page_', id, '_table') END) AS name FROM texts")
def table_context(spark: SparkSession, d: str) -> DataFrame:
    """Unit and name of a table from the text around it."""
    path = F.when(F.col("id") % 2 == 0, "A > B").otherwise("")
    return texts(spark, d).select("id", P.infer_unit(F.col("text")).alias("unit"), P.table_name(path, F.col("text"), F.col("id")).alias("name"))


@query("SELECT n::BIGINT AS n, array_to_string(list_transform(CASE n WHEN 1 THEN [0.1::DOUBLE] WHEN 2 THEN [0.1, 0.4] WHEN 3 THEN [0.1, 0.3, 0.5] WHEN 5 THEN [0.1, 0.2, 0.3, 0.4, 0.5] ELSE list_transform(range(n), lambda i: 0.1::DOUBLE + 0.4::DOUBLE * i / (n - 1)) END, lambda x: CAST(round(x * 1000) AS BIGINT)), ',') AS milli FROM (SELECT DISTINCT p_size AS n FROM part)")
def temperatures(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    milli = F.transform(P.temperatures(n), lambda x: F.round(x * 1000).cast("bigint").cast("string"))
    return table(spark, d, "part").select("p_size").distinct().select(n.cast("bigint").alias("n"), F.array_join(milli, ",").alias("milli"))


@query(f"""WITH {TEXTS_CTE}, m AS (SELECT id, text, CASE WHEN contains(text, '净利润') THEN ['净利润', '收入'] ELSE []::VARCHAR[] END AS metrics, nullif(regexp_extract(text, '{P.COMPANY}', 1), '') AS c, CAST(nullif(regexp_extract(text, '20[12][0-9]', 0), '') AS BIGINT) AS y FROM texts)
SELECT id, concat_ws(' ', c, y, CASE WHEN len(metrics) > 0 THEN array_to_string(metrics, ' ') END, text) AS diversified, CASE WHEN len(metrics) > 0 THEN concat_ws(' ', c, CASE WHEN y IS NOT NULL THEN concat(y, '年') END, array_to_string(metrics, ' ')) END AS raw FROM m WHERE y IS NOT NULL OR len(metrics) = 0 OR c IS NOT NULL""".replace(" AS raw FROM", " AS metric FROM"))
def round_two_queries(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    metrics = F.when(text.contains("净利润"), F.array(F.lit("净利润"), F.lit("收入"))).otherwise(F.array().cast("array<string>"))
    rows = texts(spark, d).select("id", "text", metrics.alias("m"), P.first_company(text).alias("c"), P.first_year(text).alias("y")).where("y is not null or size(m) = 0 or c is not null")
    return rows.select("id", P.diversified_query(F.col("c"), F.col("y"), F.col("m"), F.col("text")).alias("diversified"), P.metric_query(F.col("c"), F.col("y"), F.col("m")).alias("metric"))


@query()
def question_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Needs look-ahead, which the SQL engine's patterns lack."""
    return texts(spark, d).select("id", P.question_keywords(F.col("text")).alias("keywords"), F.to_json(P.entity_queries(F.col("text"), F.lit("两家公司均增长"), F.array(F.lit("d1"), F.lit("d2")))).alias("entities"))


def _gather(at: int) -> str:
    return "list_concat(" + ", ".join(f"CASE WHEN {_has(r[0])} THEN {r[at]!r}::VARCHAR[] ELSE []::VARCHAR[] END" for r in P.FALLBACK_RULES) + ")"


@query(f"""WITH {TEXTS_CTE}, g AS (SELECT id, text, {_gather(2)} AS f, {_gather(3)} AS s, {_gather(1)} AS k FROM texts)
SELECT id, array_to_string(CASE WHEN len(f) > 0 THEN list_sort(list_distinct(f)) ELSE ['general'] END, ',') AS fields, array_to_string(list_sort(list_distinct(list_concat({P.FALLBACK_SECTIONS!r}, s))), ',') AS sections,
  array_to_string(list_sort(list_distinct(CASE WHEN len(f) > 0 THEN k ELSE string_split_regex(trim(text), '\\s+')[1:10] END))[1:15], ' ') AS keywords FROM g""")
def fallback_packs(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select("id", P.fallback_packs(F.col("text")).alias("p")).select("id", "p.*")
    return rows.withColumn("fields", F.array_join("fields", ",")).withColumn("sections", F.array_join("sections", ","))


_FIELDS = list(P.FIELD_QUERIES)[:8]
_CASE = "CASE f " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.FIELD_QUERIES.items()) + " END"


@query(f"""WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'key words' ELSE '' END AS k, list_filter({[*_FIELDS, 'other']!r}, lambda f: length(f) % 4 = p_partkey % 4) AS fields FROM part),
t AS (SELECT id, k, list_filter(list_transform(fields, lambda f: {_CASE}), lambda x: x IS NOT NULL) AS texts, list_filter(list_transform(fields[1:3], lambda f: {_CASE}), lambda x: x IS NOT NULL) AS first FROM b),
q AS (SELECT id, list_concat(CASE WHEN k <> '' THEN [k] WHEN len(texts) > 0 THEN [array_to_string(texts, ' ')] ELSE []::VARCHAR[] END, first) AS q FROM t)
SELECT id, array_to_string(CASE WHEN len(q) > 0 THEN q ELSE ['{P.DEFAULT_FIELD_QUERY}'] END, '|') AS queries FROM q""")
def field_pack_queries(spark: SparkSession, d: str) -> DataFrame:
    fields = F.filter(F.array(*map(F.lit, [*_FIELDS, "other"])), lambda f: F.length(f) % 4 == F.col("p_partkey") % 4)
    keywords = F.when(F.col("p_partkey") % 3 == 0, "key words").otherwise("")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(P.pack_queries(keywords, fields), "|").alias("queries"))


_GAPS = {"token": (["token", "secret"], "token value", []), "License": (["License"], "License terms", []), "the": (["zzz"], "the rest", [])}


@query("WITH q AS (SELECT doc_id AS qid, text FROM documents), r(field, words, query) AS (VALUES " + ", ".join(f"('{k}', {w!r}, '{q}')" for k, (w, q, _) in _GAPS.items()) + """)
SELECT q.qid, e.doc_id, r.field, r.query FROM q, r, documents e WHERE contains(q.text, r.field) AND e.doc_id = q.qid // 2 * 2 AND len(list_filter(r.words, lambda w: contains(e.text, w))) = 0""")
def evidence_gap_queries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    asked = docs.select(F.col("doc_id").alias("qid"), F.array(F.expr("doc_id div 2 * 2")).alias("doc_ids"), "text")
    held = docs.select("doc_id", "text").join(docs.select(F.col("doc_id").alias("qid"), F.expr("doc_id div 2 * 2").alias("doc_id")), "doc_id")
    return P.evidence_gaps(asked, held, _GAPS)


@query(f"""WITH {I.UNITS_CTE}, b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY section_id ORDER BY ord, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM units)
SELECT section_id, md5(string_agg(unit_id, ',' ORDER BY ord, unit_id)) AS unit_ids, md5(substr(string_agg(text, chr(10) ORDER BY ord) FILTER (before < 900), 1, 1200)) AS preview FROM b GROUP BY section_id""")
def section_preview(spark: SparkSession, d: str) -> DataFrame:
    return parsing.section_preview(I.units(spark, d)).select("section_id", F.md5(F.array_join("unit_ids", ",")).alias("unit_ids"), F.md5("preview").alias("preview"))


@query(f"""WITH {I.LINES_CTE}, o AS (SELECT doc_id, ord, line, lag(line) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM lines)
SELECT doc_id, ord FROM o WHERE line IS DISTINCT FROM before AND length(line) >= 3 AND NOT ((contains(line, 'License') OR contains(line, '!!')) AND length(line) < 50)""")
def clean_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = I.lines(spark, d).select("doc_id", "ord", F.col("line").alias("text"))
    return parsing.clean_paragraphs(rows, ["License", "!!"]).select("doc_id", "ord")


@query(r"SELECT doc_id, doc_id % 5 AS page, length(regexp_replace(text, '\s+', '', 'g')) AS text_len, 'page_image_stub' AS unit_type FROM documents WHERE doc_id % 7 = 0 OR length(regexp_replace(text, '\s+', '', 'g')) < 300")
def image_stubs(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 5).alias("page"), "text", (F.col("doc_id") % 7 == 0).cast("int").alias("images"))
    return parsing.image_stubs(pages, 300)


@query()
def field_lines(spark: SparkSession, d: str) -> DataFrame:
    """A consuming cursor: checked against hand-made pages in the tests."""
    rows = I.lines(spark, d).select("doc_id", F.lit(1).cast("bigint").alias("page"), "ord", "line")
    return parsing.field_lines(rows, LATIN.metrics)


TOP = """
, top AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 4) DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 5),"""


@query(bm25_sql(DOCS, ITEMS, tail=TOP + f"""
c AS (SELECT top.qid, top.rank, {proxy_sql('b.text', 'd.lang')} AS terms, regexp_replace(d.text, '\\s+', '', 'g') AS hay FROM top JOIN documents d ON d.doc_id = top.id JOIN benchmark b ON b.item_id = top.qid),
h AS (SELECT qid, rank, len(terms) > 0 AND len(list_filter(terms, lambda t: contains(hay, regexp_replace(t, '\\s+', '', 'g')))) / len(terms)::DOUBLE >= 0.5 AS hit FROM c)
SELECT qid, count(*) FILTER (hit) AS n_hit, coalesce(min(rank) FILTER (hit), 0) AS first_hit FROM h GROUP BY qid"""))
def item_proxy_recall(spark: SparkSession, d: str) -> DataFrame:
    """Which of the best documents cover a question's terms: number and first rank."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    docs = table(spark, d, "documents")
    top = bm25.ranked(bm25.shared_index(docs, "doc_id", "text"), bm25.query_terms(items, "qid", "text"), "qid", 5)
    rows = top.join(docs.select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("evidence")), "id").join(items, "qid")
    share, _ = T.proxy_coverage(T.proxy_terms(F.col("text"), F.col("lang"), LATIN.proxy_terms, []), F.col("evidence"))
    return evaluation.item_hits(rows.select("qid", "rank", (share >= 0.5).alias("hit")))


@query("""WITH p AS (SELECT doc_id, doc_id % 9 AS page FROM documents), s AS (SELECT DISTINCT doc_id % 3 AS doc_id, page, 0 AS priority FROM p WHERE page < 4 UNION SELECT DISTINCT doc_id % 3, page, 1 FROM p),
o AS (SELECT doc_id, page, min(priority) AS priority FROM s GROUP BY doc_id, page)
SELECT doc_id, page, priority, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, page) AS place FROM o) WHERE place <= 6""")
def pages_to_render(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.sources.sinks import pages_to_render as pages

    rows = table(spark, d, "documents").select((F.col("doc_id") % 3).alias("doc_id"), (F.col("doc_id") % 9).alias("page")).distinct()
    return pages(rows.where("page < 4"), rows, 6)


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) AS total FROM orders""")
def build_statistics(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.sources.sinks import build_statistics as statistics

    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "skipped").when(F.col("o_orderstatus") == "P", "failed")
    return statistics(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), status.alias("status")))


@query("""WITH h AS (SELECT doc_id % 20 AS qid, doc_id AS id, n_chars AS score FROM documents WHERE lang = 'fr'), n AS (SELECT qid, count(*) AS n FROM h GROUP BY qid),
q AS (SELECT DISTINCT doc_id % 20 AS qid FROM documents), few AS (SELECT qid FROM q LEFT JOIN n USING (qid) WHERE coalesce(n, 0) < 6)
SELECT qid, id, score FROM h WHERE qid NOT IN (SELECT qid FROM few) UNION ALL SELECT doc_id % 20, doc_id, n_chars FROM documents WHERE doc_id % 20 IN (SELECT qid FROM few)""")
def global_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Questions with too few restricted hits take those of the unrestricted search."""
    rows = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("qid"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), "lang")
    return retrieval.with_fallback(rows.where("lang = 'fr'").drop("lang"), rows.drop("lang"), rows.select("qid").distinct(), 6)
