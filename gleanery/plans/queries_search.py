"""Queries over composed searches and what surrounds them, on tables where every branch is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.vocab import LATIN
from gleanery.operators import bm25, evaluation, parsing, retrieval, search
from gleanery.operators import segmentation as S
from gleanery.plans import inputs as I
from gleanery.plans.queries_index import DEPTH_SQL, NUMS_SQL, TOK, YEARS_SQL, _dom, _has, _named_sql, bm25_sql  # noqa: F401
from gleanery.plans.registry import query
from gleanery.session import table

#: Turns of conversations as units: kinds, names and sections go by role and turn, so every boost is reached.
TURNS_CTE = """turns AS (SELECT concat(conv_id, ':', turn) AS unit_id, conv_id AS doc_id, concat(conv_id, '/', role) AS section_id, turn AS ord, text,
    CASE role WHEN 'assistant' THEN 'field_card' WHEN 'user' THEN 'text' ELSE 'page_image_stub' END AS unit_type,
    CASE turn % 3 WHEN 0 THEN 'licence' WHEN 1 THEN 'mail' END AS name, CASE WHEN turn % 2 = 0 THEN 'A > License' ELSE 'A' END AS path FROM conversations)"""
#: Questions that name metrics, a year and numbers besides their own words.
ASKED_CTE = "asked AS (SELECT item_id AS qid, concat(text, ' License or mail @ in 2024 and 20%') AS query FROM benchmark)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "field_card").when(F.col("role") == "user", "text").otherwise("page_image_stub")
    name = F.when(F.col("turn") % 3 == 0, "licence").when(F.col("turn") % 3 == 1, "mail")
    return table(spark, d, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("unit_id"), F.col("conv_id").alias("doc_id"), F.concat_ws("/", "conv_id", "role").alias("section_id"), F.col("turn").alias("ord"), "text",
        kind.alias("unit_type"), name.alias("name"), F.when(F.col("turn") % 2 == 0, "A > License").otherwise("A").alias("path"),
    )


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat("text", F.lit(" License or mail @ in 2024 and 20%")).alias("query"))


_ALIASES = "array_to_string(list_distinct(list_concat(" + ", ".join(f"CASE WHEN {_has('query', [m, *a])} THEN {[m, *dict.fromkeys(x for x in a if x != m)]!r} ELSE []::VARCHAR[] END" for m, a in LATIN.metrics.items()) + ")), ' ')"
_EXACT = " + ".join(f"CASE WHEN {_has('query', [m, *a])} AND name = '{m}' THEN 8.0::DOUBLE ELSE 0 END" for m, a in LATIN.metrics.items())
_WORDS = r"len(list_filter(list_distinct(regexp_extract_all(query, '20[0-9]{2}|[0-9]+(?:\.[0-9]+)?%?')), lambda w: contains(hay, w))) * 0.6::DOUBLE"


@query(bm25_sql("SELECT unit_id AS id, text FROM turns", "SELECT qid, query AS text FROM grown", tail=f""",
b AS (SELECT s.qid, s.id, s.score, t.text AS hay, t.name, t.path, t.unit_type AS kind, g.query FROM scored s JOIN turns t ON t.unit_id = s.id JOIN grown g ON g.qid = s.qid WHERE s.score > 0 AND t.unit_type IN ('field_card', 'text')),
r AS (SELECT qid, id, round(score + coalesce({_EXACT}, 0) + {_named_sql(3.0, LATIN.metrics)} + {YEARS_SQL} * 1.2::DOUBLE + {_named_sql(1.0, LATIN.companies)}
  + CASE WHEN {_has('path', LATIN.section_priors)} THEN 0.8::DOUBLE ELSE 0 END + CASE kind WHEN 'field_card' THEN 2.5::DOUBLE ELSE 0 END + {_WORDS}, 4) AS score FROM b)
SELECT qid, id AS unit_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 10""").replace(
    "WITH d AS", f"WITH {TURNS_CTE}, {ASKED_CTE}, grown AS (SELECT qid, concat_ws(' ', query, {_ALIASES}) AS query FROM asked), d AS", 1))
def simple_search(spark: SparkSession, d: str) -> DataFrame:
    """Queries grown by aliases, BM25, domain boost and word bonus; only cards and texts are allowed."""
    return search.simple_search(asked(spark, d), turns(spark, d), 10, LATIN, allow=["field_card", "text"])


@query(f"""WITH {TURNS_CTE} SELECT unit_id FROM turns WHERE unit_type IN ('field_card', 'page_image_stub') AND unit_type NOT IN ('page_image_stub')""")
def allow_deny(spark: SparkSession, d: str) -> DataFrame:
    return search.of_kinds(turns(spark, d), ["field_card", "page_image_stub"], ["page_image_stub"]).select("unit_id")


@query("""WITH v AS (SELECT vec_id // 8 AS doc_id, vec_id % 8 AS chunk_id, embedding[1]::DOUBLE AS first FROM embeddings)
SELECT d.doc_id, c.chunk_id, v.first FROM documents d, (VALUES (0::BIGINT), (3), (9)) AS c(chunk_id) JOIN v ON v.doc_id = d.doc_id AND v.chunk_id = c.chunk_id""")
def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents with the vectors that carry their document and number; others drop out."""
    chunks = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(3), F.lit(9))).alias("chunk_id"))
    vectors = table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("doc_id"), (F.col("vec_id") % 8).cast("bigint").alias("chunk_id"), F.col("embedding").alias("vec"))
    return search.align_vectors(chunks, vectors).select("doc_id", "chunk_id", F.get("vec", F.lit(0)).cast("double").alias("first"))


@query("""WITH lex AS (SELECT c_custkey % 20 AS qid, CASE WHEN c_custkey % 2 = 0 THEN 'stem' ELSE 'option_A' END AS label, c_nationkey::BIGINT AS id, max(c_acctbal) AS score FROM customer GROUP BY ALL),
den AS (SELECT s_suppkey % 20 AS qid, 'stem' AS label, s_nationkey::BIGINT AS id, max(s_acctbal) AS score FROM supplier GROUP BY ALL),
r AS (SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS rank FROM lex) WHERE rank <= 10
  UNION ALL SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS rank FROM den) WHERE rank <= 10),
f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r GROUP BY qid, id)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 8""")
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Lexical lists of stem and options fused with dense ones."""
    label = F.when(F.col("c_custkey") % 2 == 0, "stem").otherwise("option_A")
    lexical = table(spark, d, "customer").groupBy((F.col("c_custkey") % 20).alias("qid"), label.alias("label"), F.col("c_nationkey").cast("bigint").alias("id")).agg(F.max("c_acctbal").alias("score"))
    dense = table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 20).alias("qid"), F.lit("stem").alias("label"), F.col("s_nationkey").cast("bigint").alias("id")).agg(F.max("s_acctbal").alias("score"))
    return search.hybrid_search(lexical, dense)


@query(f"""WITH {TURNS_CTE}, hits AS (SELECT doc_id % 7 AS qid, doc_id, l.label, unit_id, CAST((length(text) * l.f) % 97 AS DOUBLE) AS score FROM turns, (VALUES ('stem', 3), ('option_A', 5)) AS l(label, f)),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id, label ORDER BY score DESC, unit_id) AS k FROM hits) WHERE k <= 10),
f AS (SELECT qid, doc_id, unit_id, sum(1.0::DOUBLE / (60 + k)) AS s FROM r GROUP BY ALL),
w AS (SELECT f.qid, f.doc_id, f.unit_id, round(CASE WHEN contains(t.path, 'License') OR t.ord <= 2 THEN s * 1.5 ELSE s END, 6) AS score FROM f JOIN turns t USING (unit_id))
SELECT qid, doc_id, unit_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, unit_id) AS rank FROM w) WHERE rank <= 4""")
def per_document_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Several rankings inside every document, fused, with preferred sections raised."""
    units = turns(spark, d)
    lists = F.array(*(F.struct(F.lit(n).alias("label"), F.lit(f).alias("f")) for n, f in (("stem", 3), ("option_A", 5))))
    hits = units.select((F.col("doc_id") % 7).alias("qid"), "doc_id", "unit_id", "text", F.explode(lists).alias("l")).select("qid", "doc_id", "l.label", "unit_id", ((F.length("text") * F.col("l.f")) % 97).cast("double").alias("score"))
    sections = units.select("unit_id", F.col("path").alias("title"), F.col("ord").alias("page"))
    return search.per_document_fusion(hits, sections, ["cover", "rights"], {"rights": ["License"]}, most=4)


@query("""WITH h AS (SELECT c_custkey % 30 AS qid, CASE WHEN c_custkey % 2 = 0 THEN 'stem' ELSE 'option_A' END AS label, c_nationkey::BIGINT AS chunk_id, max(c_acctbal) AS score FROM customer GROUP BY ALL),
k AS (SELECT qid, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, chunk_id) AS k FROM h) WHERE k <= CASE label WHEN 'stem' THEN 5 ELSE 2 END
  UNION ALL SELECT DISTINCT s_suppkey % 30, s_nationkey::BIGINT, 1.0::DOUBLE FROM supplier),
a AS (SELECT qid, chunk_id, round(sum(score), 4) AS score, repeat(n_name || ' ', 90) AS text FROM k JOIN nation ON n_nationkey = chunk_id GROUP BY qid, chunk_id, n_name),
u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY qid ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT qid, chunk_id, score, md5(substr(text, 1, CAST(3000 - before AS INT))) AS text FROM u WHERE before < 3000""")
def options_and_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Scores of stem, options and numbers added up per chunk, texts within 3,000 characters."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("chunk_id"), F.repeat(F.concat("n_name", F.lit(" ")), F.lit(90)).alias("text"))
    label = F.when(F.col("c_custkey") % 2 == 0, "stem").otherwise("option_A")
    hits = table(spark, d, "customer").groupBy((F.col("c_custkey") % 30).alias("qid"), label.alias("label"), F.col("c_nationkey").cast("bigint").alias("chunk_id")).agg(F.max("c_acctbal").alias("score"))
    numbers = table(spark, d, "supplier").select((F.col("s_suppkey") % 30).alias("qid"), F.col("s_nationkey").cast("bigint").alias("chunk_id"), F.lit(1.0).alias("score")).distinct()
    out = search.options_and_numbers(hits.join(names, "chunk_id"), numbers.join(names, "chunk_id"), ["chunk_id"])
    return out.select("qid", "chunk_id", "score", F.md5("text").alias("text"))


@query(f"""WITH q AS (SELECT item_id AS qid, list_distinct({TOK.format('text')}) AS asked, [c.a, c.b, c.c, c.e] AS docs FROM benchmark, (SELECT min(conv_id) AS a, min(conv_id) + 1 AS b, min(conv_id) + 2 AS c, max(conv_id) AS e FROM conversations) c),
b AS (SELECT conv_id AS doc_id, turn AS ord, list_distinct({TOK.format('text')}) AS terms FROM conversations),
p AS (SELECT q.qid, u.i AS place, b.doc_id, b.ord, CAST(len(list_intersect(q.asked, b.terms)) AS BIGINT) AS score FROM q, unnest(range(1, 4)) AS u(i) JOIN b ON b.doc_id = q.docs[u.i]),
m AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM p)
SELECT qid, doc_id, ord, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, place, ord) AS rank FROM m WHERE score > 0 OR best = 0) WHERE rank <= 5""")
def overlap_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a question's first three documents by shared terms."""
    rows = table(spark, d, "conversations")
    ends = rows.agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("e"))
    questions = table(spark, d, "benchmark").join(F.broadcast(ends)).select(F.col("item_id").alias("qid"), F.array_distinct(T.simple_tokens(F.col("text"))).alias("terms"), F.array(F.col("a"), F.col("a") + 1, F.col("a") + 2, F.col("e")).alias("doc_ids"))
    return search.overlap_fallback(questions, rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.array_distinct(T.simple_tokens(F.col("text"))).alias("terms")))


@query(f"""WITH {TURNS_CTE}, c AS (SELECT o_orderkey AS card_id, concat(o_custkey % 40, ':', o_orderkey % 9) AS source_unit_id FROM orders),
s AS (SELECT DISTINCT section_id, path AS section_path FROM turns WHERE ord = 0)
SELECT card_id, source_unit_id, t.section_id, md5(t.text) AS unit_text, s.section_path FROM c LEFT JOIN turns t ON t.unit_id = c.source_unit_id LEFT JOIN s ON s.section_id = t.section_id""")
def card_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Cards with their unit and its section, where there are any."""
    units = turns(spark, d)
    cards = table(spark, d, "orders").select(F.col("o_orderkey").alias("card_id"), F.concat_ws(":", F.col("o_custkey") % 40, F.col("o_orderkey") % 9).alias("source_unit_id"))
    sections = units.where("ord = 0").select("section_id", F.col("path").alias("section_path")).distinct()
    return search.with_ancestors(cards, units, sections).select("card_id", "source_unit_id", "section_id", F.md5("unit_text").alias("unit_text"), "section_path")


@query("""SELECT o_custkey AS qid, concat('e', o_orderkey % 5) AS evidence_id, max(o_totalprice) AS score, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS labels,
  array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS covers, max_by(CAST(o_orderkey AS VARCHAR), o_totalprice) AS content FROM orders GROUP BY o_custkey, o_orderkey % 5""")
def pooled_evidence(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.concat(F.lit("e"), F.col("o_orderkey") % 5).alias("evidence_id"), F.col("o_orderpriority").alias("label"), F.array("o_orderstatus").alias("covers"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").cast("string").alias("content"))
    return search.pool_evidence(items).withColumn("labels", F.array_join("labels", ",")).withColumn("covers", F.array_join("covers", ","))


@query("""SELECT DISTINCT l_orderkey AS qid, l_partkey AS evidence_id, o_orderstatus AS option FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""")
def counter_links(spark: SparkSession, d: str) -> DataFrame:
    """What counter searches brought in, linked to the option that it speaks against."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_orderkey").alias("call"), F.col("l_partkey").alias("evidence_id"))
    tool = F.when(F.col("o_orderpriority") == "1-URGENT", "counter_search").otherwise("option_search")
    return search.link_counter(items, table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderkey").alias("call"), tool.alias("tool"), F.col("o_orderstatus").alias("option")))


@query("SELECT event_id, event_type AS domain, value AS score FROM events WHERE value >= 4.0 OR event_type IN ('click', 'error') AND value IS NOT NULL")
def strong_cards(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("domain"), F.col("value").alias("score"))
    return search.strong_cards(rows, ["click", "error"])


@query("""WITH p AS (SELECT o_custkey AS qid, o_orderkey % 7 AS doc_id FROM orders), k AS (SELECT DISTINCT c_custkey AS qid, c_custkey % 7 AS doc_id FROM customer),
v AS (SELECT p.* FROM p WHERE EXISTS (SELECT 1 FROM k WHERE k.qid = p.qid AND k.doc_id = p.doc_id))
SELECT * FROM v UNION ALL SELECT c_custkey, -1::BIGINT FROM customer WHERE c_custkey NOT IN (SELECT qid FROM v)""")
def valid_packs(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer")
    packs = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 7).alias("doc_id"))
    known = customers.select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") % 7).alias("doc_id"))
    return search.valid_packs(packs, known, customers.select(F.col("c_custkey").alias("qid"), F.lit(-1).cast("bigint").alias("doc_id")))


@query("""WITH r AS (SELECT c_custkey AS qid, c_custkey % 11 AS n_items, c_name AS evidence FROM customer), w AS (SELECT s_suppkey AS qid, 9::BIGINT AS n_items, repeat(s_name, 1 + CAST(s_suppkey % 2 AS INT)) AS evidence FROM supplier),
j AS (SELECT r.*, w.n_items AS wn, w.evidence AS we, r.n_items < 6 AND length(coalesce(w.evidence, '')) > length(r.evidence) AS swapped FROM r LEFT JOIN w USING (qid))
SELECT qid, CASE WHEN swapped THEN wn ELSE n_items END AS n_items, CASE WHEN swapped THEN we ELSE evidence END AS evidence, swapped FROM j""")
def longer_evidence(spark: SparkSession, d: str) -> DataFrame:
    routed = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") % 11).alias("n_items"), F.col("c_name").alias("evidence"))
    whole = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.lit(9).cast("bigint").alias("n_items"), F.repeat("s_name", (1 + F.col("s_suppkey") % 2).cast("int")).alias("evidence"))
    return search.longer_evidence(routed, whole)


@query(f"""WITH {I.VOTES_CTE}, v AS (SELECT qid, round, answer, CASE WHEN qid % 2 = 0 THEN 'multi' ELSE 'mcq' END AS answer_format, (length(answer) + round % 3) / 4.0::DOUBLE AS confidence FROM votes)
SELECT qid, round, answer, answer_format, confidence FROM v WHERE answer_format = 'multi' AND length(answer) <= 1 OR confidence < 0.67""")
def asks_again(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("qid") % 2 == 0, "multi").otherwise("mcq")
    return search.asks_again(I.votes(spark, d).select("qid", "round", "answer", kind.alias("answer_format"), ((F.length("answer") + F.col("round") % 3) / 4).alias("confidence")))


@query(f"WITH {I.PRED_CTE} SELECT p.qid, p.domain, p.answer, g.answer AS gold, p.answer = g.answer AS correct FROM predicted p LEFT JOIN gold g USING (qid)")
def results_left_gold(spark: SparkSession, d: str) -> DataFrame:
    """Results without a gold answer stay, and count neither way."""
    predicted, gold = I.predictions(spark, d)
    return evaluation.compare_all(predicted, gold).select("qid", "domain", "answer", "gold", "correct")


_FIRST = "(SELECT event_type AS by_, event_id % 8 AS first FROM events)"


@query(f"""SELECT by_ AS domain, count(*) AS n, round(count(*) FILTER (first BETWEEN 1 AND 1) / count(*)::DOUBLE, 4) AS hit_1, round(count(*) FILTER (first BETWEEN 1 AND 3) / count(*)::DOUBLE, 4) AS hit_3,
  round(count(*) FILTER (first BETWEEN 1 AND 5) / count(*)::DOUBLE, 4) AS hit_5 FROM {_FIRST} GROUP BY ROLLUP (by_)""")
def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.hit_rates(table(spark, d, "events").select(F.col("event_type").alias("domain"), (F.col("event_id") % 8).alias("first")), "domain")


@query("""SELECT event_id, event_type, CAST(floor(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) * 100 + 0.371713) AS BIGINT) AS hundredths FROM events""")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Means so far in hundredths; the odd addend keeps exact halves away from the rounding."""
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("value").alias("confidence"))
    return evaluation.mean_confidence(rows, "event_type", "event_id").select("event_id", "event_type", F.floor(F.col("mean_confidence") * 100 + 0.371713).alias("hundredths"))


@query("""WITH i AS (SELECT l_orderkey AS qid, o_orderstatus AS domain, l_linenumber::BIGINT AS rank, l_quantity AS score, l_returnflag = 'R' AS hit FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT qid, domain, count(*) AS n_items, count(*) FILTER (hit) AS n_hit, coalesce(min(rank) FILTER (hit), 0) AS first, round(max(score), 4) AS best FROM i GROUP BY ALL)
SELECT domain, count(*) AS n, CAST(sum(n_items) AS BIGINT) AS n_items, count(*) FILTER (first > 0) AS n_with_hit, round(avg(best), 4) AS mean_best FROM p GROUP BY ROLLUP (domain)""")
def retrieval_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = items.select(F.col("l_orderkey").alias("qid"), F.col("o_orderstatus").alias("domain"), F.col("l_linenumber").cast("bigint").alias("rank"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("hit"))
    return evaluation.diagnostics(rows)[1]


#: Lines of a rule text, a contents page and a report, made from numbers so that every rule acts.
RULE_LINES = ("第{}章 总则", "第{}条 内容", "第{}节 办法", "第{}条 期限", "正文", "附录{}")
RULES_CTE = "rule_lines AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN replace('{t}', '{{}}', CAST(o_orderkey % 40 AS VARCHAR))" for i, t in enumerate(RULE_LINES)) + " END AS line FROM orders)"


@query(f"""WITH {RULES_CTE}, c AS (SELECT *, regexp_matches(line, '^第[0-9]+章|^附[录件]') AS ch, regexp_matches(line, '^第[0-9]+节') AS se, nullif(regexp_extract(line, '^(第[0-9]+条)', 1), '') AS ar FROM rule_lines),
a AS (SELECT *, sum(CAST(ch AS INT)) OVER (PARTITION BY doc_id ORDER BY ord) AS nc FROM c),
b AS (SELECT *, sum(CAST(se AS INT)) OVER (PARTITION BY doc_id, nc ORDER BY ord) AS ns FROM a)
SELECT doc_id, ord, last_value(CASE WHEN ch THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id, nc ORDER BY ord) AS chapter, last_value(CASE WHEN se THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id, nc ORDER BY ord) AS section,
  last_value(ar IGNORE NULLS) OVER (PARTITION BY doc_id, nc, ns ORDER BY ord) AS article FROM b""")
def regulatory_sections(spark: SparkSession, d: str) -> DataFrame:
    """Chapters, sections and articles carried forward over numbered lines."""
    k = (F.col("o_orderkey") % 40).cast("string")
    lines = F.array(*(F.replace(F.lit(t), F.lit("{}"), k) for t in RULE_LINES))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.get(lines, (F.col("o_orderkey") % 6).cast("int")).alias("line"))
    return S.regulatory_sections(rows, "doc_id").select("doc_id", "ord", "chapter", "section", "article")


@query("""WITH l AS (SELECT o_custkey % 5 AS doc_id, o_orderkey % 15 AS page, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['目录', '第一节 释义'] ELSE ['第二节 公司', CAST(o_orderkey % 90 AS VARCHAR)] END) AS line FROM orders)
SELECT doc_id, page FROM l GROUP BY ALL HAVING bool_or(contains(line, '目录')) AND page <= 12 AND count(*) FILTER (starts_with(line, '第')) >= 4 AND count(*) FILTER (regexp_matches(line, '^[0-9]{1,4}$')) >= 4""")
def toc_pages(spark: SparkSession, d: str) -> DataFrame:
    named = F.array(F.lit("目录"), F.lit("第一节 释义"))
    other = F.array(F.lit("第二节 公司"), (F.col("o_orderkey") % 90).cast("string"))
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("doc_id"), (F.col("o_orderkey") % 15).alias("page"), F.explode(F.when(F.col("o_orderkey") % 4 == 0, named).otherwise(other)).alias("line"))
    return S.toc_pages(rows, "doc_id", "page")


@query("""WITH p AS (SELECT c_custkey AS doc_id, unnest([1, 2]) AS page, c_nationkey AS k FROM customer),
t AS (SELECT doc_id, page, CASE WHEN page = 2 THEN 'page two' WHEN k % 3 = 0 THEN concat('Alpha股份有限公司 20', 10 + k, ' 年度报告') WHEN k % 3 = 1 THEN concat('年度报告 20', 10 + k) ELSE 'nothing' END AS text FROM p),
r AS (SELECT doc_id, count(*) AS page_count, string_agg(text, chr(10) ORDER BY page) AS t FROM t GROUP BY doc_id)
SELECT doc_id, CASE WHEN contains(t, 'Alpha') THEN 'Alpha股份有限公司' ELSE '' END AS company, CAST(nullif(regexp_extract(t, '20[0-9]{2}'), '') AS BIGINT) AS year, page_count,
  CASE WHEN contains(t, 'Alpha') THEN concat('Alpha股份有限公司', regexp_extract(t, '20[0-9]{2}'), '年度报告') ELSE CAST(doc_id AS VARCHAR) END AS title FROM r""")
def document_cards(spark: SparkSession, d: str) -> DataFrame:
    """Title, company, year and pages of reports."""
    k, year = F.col("c_nationkey"), (10 + F.col("c_nationkey")).cast("string")
    first = F.when(k % 3 == 0, F.concat(F.lit("Alpha股份有限公司 20"), year, F.lit(" 年度报告"))).when(k % 3 == 1, F.concat(F.lit("年度报告 20"), year)).otherwise("nothing")
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.array(first, F.lit("page two"))).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return parsing.document_cards(pages, {}).select("doc_id", "company", "year", "page_count", "title")


@query("""WITH n AS (SELECT n_regionkey AS t, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT t, k AS row, n_name AS row_header, CAST(n_nationkey AS VARCHAR) AS v2024, CAST(n_nationkey * 2 AS VARCHAR) AS last, 5 + 2 AS lines FROM n""")
def table_units(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables as value maps by header; of equal headers the last value wins."""
    nation = table(spark, d, "nation")
    n = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    body = nation.select(F.col("n_regionkey").alias("t"), n.alias("row"), F.array("n_name", F.col("n_nationkey").cast("string"), F.lit("x"), (F.col("n_nationkey") * 2).cast("string")).alias("cells"))
    head = nation.select(F.col("n_regionkey").alias("t"), F.lit(0).alias("row"), F.array(F.lit("Name"), F.lit("2024"), F.lit("both"), F.lit("both")).alias("cells")).distinct()
    out = S.table_units(head.unionByName(body), "t")
    return out.select("t", (F.col("row") + 1).alias("row"), "row_header", F.col("values")["2024"].alias("v2024"), F.col("values")["both"].alias("last"), F.size(F.split("markdown", "\n")).alias("lines"))


@query("""SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'regulatory' ELSE 'research' END AS domain,
  CASE WHEN c_custkey % 4 = 0 THEN concat('/d/csrc_', c_custkey, '.html') WHEN c_custkey % 4 = 1 THEN concat('/d/', c_custkey, '.PDF') WHEN c_custkey % 4 = 2 THEN concat('/d/', c_custkey, '.pdf') END AS path,
  CASE c_custkey % 4 WHEN 0 THEN 'html' WHEN 3 THEN 'unknown' ELSE 'pdf' END AS file_type FROM customer""")
def resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    """Documents to files by domain, name and kind."""
    from gleanery.sources.files import resolve_paths as resolve

    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    name = F.when(key % 4 == 0, F.concat(F.lit("csrc_"), text)).otherwise(text)
    wanted = table(spark, d, "customer").select(name.alias("doc_id"), F.when(key % 4 == 0, "regulatory").otherwise("research").alias("domain"))
    named = F.when(key % 4 == 0, F.array(F.concat(F.lit("csrc_"), text, F.lit(".html")))).when(key % 4 == 1, F.array(F.concat(text, F.lit(".pdf")), F.concat(text, F.lit(".PDF")))).when(key % 4 == 2, F.array(F.concat(text, F.lit(".pdf")), F.concat(text, F.lit(".txt")))).otherwise(F.array(F.concat(text, F.lit(".txt"))))
    files = table(spark, d, "customer").select(F.explode(named).alias("name")).select(F.concat(F.lit("/d/"), "name").alias("path"), "name", F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"))
    got = resolve(wanted, files.withColumn("file_type", T.file_type(F.col("path"))))
    return got.select(F.regexp_replace("doc_id", "csrc_", "").cast("bigint").alias("doc_id"), "domain", "path", "file_type")
