"""Queries over indexes, retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.vocab import LATIN
from gleanery.operators import bm25, retrieval, scoring, search
from gleanery.operators import segmentation as S
from gleanery.plans import inputs as I
from gleanery.plans.registry import query
from gleanery.session import table

TOK = r"regexp_extract_all(lower({}), '[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)?%?')"


def bm25_sql(docs: str, queries: str, scope: str = "0", tail: str = "", okapi: bool = False) -> str:
    """BM25 in SQL. docs: (id, text[, scope]); queries: (qid, text)."""
    idf = (
        "idf0 AS (SELECT scope, term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df JOIN stats USING (scope)), "
        "idf AS (SELECT scope, term, avgdl, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY scope) ELSE r END AS idf FROM idf0)"
        if okapi else "idf AS (SELECT scope, term, avgdl, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df JOIN stats USING (scope))"
    )
    return f"""
WITH d AS (SELECT *, {TOK.format('text')} AS toks, {scope} AS scope FROM ({docs})),
stats AS (SELECT scope, count(*) AS n, avg(len(toks)) AS avgdl FROM d GROUP BY scope),
tf AS (SELECT scope, id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT scope, id, len(toks) AS dl, unnest(toks) AS term FROM d) GROUP BY scope, id, term),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY scope, term),
{idf},
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({TOK.format('text')}) AS term FROM ({queries})) GROUP BY qid, term),
scored AS (SELECT qid, scope, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * {'dl' if okapi else 'greatest(1, dl)'} / avgdl))) AS score
  FROM q JOIN idf USING (term) JOIN tf USING (scope, term) GROUP BY qid, scope, id){tail}"""


TOP5 = """
SELECT qid, id AS doc_id, score, rank FROM (
  SELECT qid, id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 4) DESC, id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 5"""
DOCS, ITEMS = "SELECT doc_id AS id, text FROM documents", "SELECT item_id AS qid, text FROM benchmark"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _ranked(index: bm25.Index, items: DataFrame, k: int = 5, okapi: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    best = bm25.ranked(index, bm25.query_terms(items, "qid", "text"), "qid", k, okapi=okapi, allowed=allowed)
    return best.select("qid", F.col("id").alias("doc_id"), "score", "rank")


@query(bm25_sql(DOCS, ITEMS, tail=TOP5))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    index = bm25.shared_index(table(spark, d, "documents"), "doc_id", "text")
    return _ranked(index, _items(spark, d))


@query(bm25_sql(DOCS, ITEMS, tail=TOP5, okapi=True))
def bm25_okapi_topk(spark: SparkSession, d: str) -> DataFrame:
    index = bm25.shared_index(table(spark, d, "documents"), "doc_id", "text")
    return _ranked(index, _items(spark, d), okapi=True)


@query(bm25_sql("SELECT doc_id AS id, text, lang FROM documents", ITEMS, scope="lang", tail=TOP5))
def bm25_domain_scope(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each domain on its own."""
    index = bm25.shared_index(table(spark, d, "documents"), "doc_id", "text", scope=F.col("lang"))
    return _ranked(index, _items(spark, d))


@query(bm25_sql(DOCS, ITEMS, tail=""", hit AS (SELECT s.* FROM scored s JOIN documents d ON d.doc_id = s.id WHERE d.lang = 'en')
SELECT qid, id AS doc_id, score, rank FROM (SELECT qid, id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 4) DESC, id) AS rank FROM hit WHERE score > 0) WHERE rank <= 5"""))
def bm25_hard_filter(spark: SparkSession, d: str) -> DataFrame:
    """Only allowed documents are ranked after scoring, so statistics stay those of the corpus."""
    docs = table(spark, d, "documents")
    allowed = docs.where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return _ranked(bm25.shared_index(docs, "doc_id", "text"), _items(spark, d), allowed=allowed)


@query(rf"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term""")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    index = bm25.shared_index(table(spark, d, "documents"), "doc_id", "text")
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


UNIT_INDEX = "SELECT unit_id AS id, text, doc_id FROM units"


@query(bm25_sql(UNIT_INDEX, ITEMS, scope="doc_id", tail=""",
r AS (SELECT qid, scope AS doc_id, id, round(score, 4) AS score FROM scored WHERE round(score, 4) > 0),
n AS (SELECT qid, count(DISTINCT doc_id) AS n FROM r GROUP BY qid),
a AS (SELECT r.*, n, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, id) AS doc_rank FROM r JOIN n USING (qid))
SELECT qid, doc_id, id AS unit_id, score, doc_rank, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, id) AS rank FROM a WHERE doc_rank <= greatest(3, 10 // n)) WHERE rank <= 10""").replace("WITH d AS", "WITH " + I.UNITS_CTE + ", d AS", 1))
def two_level_topk(spark: SparkSession, d: str) -> DataFrame:
    index = bm25.shared_index(I.units(spark, d), "unit_id", "text", scope=F.col("doc_id"))
    best = bm25.two_level_best(index, bm25.query_terms(_items(spark, d), "qid", "text"), "qid", 10)
    return best.select("qid", F.col("scope").alias("doc_id"), F.col("id").alias("unit_id"), "score", "doc_rank", "rank")


def _cosine_sql(k: int) -> str:
    return f"""
q AS (SELECT vec_id AS qid, embedding AS qvec FROM embeddings WHERE vec_id % 100 = 0),
pairs AS (SELECT qid, vec_id AS id, round(list_sum(list_transform(list_zip(qvec, embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(qvec, lambda v: v::DOUBLE * v::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)))), 6) AS score FROM q, embeddings),
dense AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pairs WHERE score > 0) WHERE rank <= {k})"""


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = vectors.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return retrieval.dense_top_k(asked, vectors, k)


@query(f"WITH {_cosine_sql(5)} SELECT qid, id, score, rank FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 5).select("qid", "id", "score", "rank")


@query(f"""WITH {_cosine_sql(10)},
other AS (SELECT * FROM (SELECT q.vec_id AS qid, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY e.vec_id) AS rank FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 100 = 0) WHERE rank <= 10)
SELECT qid, id, score, rank FROM (SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS rank FROM (
  SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT qid, id, rank FROM dense UNION ALL SELECT * FROM other) GROUP BY qid, id)) WHERE rank <= 8""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Dense ranking fused with the ranking of vectors of the same label."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = vectors.where("id % 100 = 0")
    # The first of a label are the same for every query: cut before the join.
    first = bm25.top_k(vectors.withColumn("score", -F.col("id")), ["label"], 10, "id").select("label", "id", "rank")
    other = asked.select(F.col("id").alias("qid"), "label").join(first, "label").select("qid", "id", "rank")
    both = _dense(spark, d, 10).select("qid", "id", "rank").unionByName(other)
    fused = retrieval.reciprocal_ranks(both, ["qid", "id"]).withColumn("score", F.round("score", 6))
    return bm25.top_k(fused, ["qid"], 8, "id").select("qid", "id", "score", "rank")


@query(f"""WITH {I.Q_CTE}
SELECT qid, 'stem' AS label, question AS query, 10::BIGINT AS topk FROM questions
UNION ALL SELECT qid, concat('option_', option), concat(question, chr(10), option, '. ', body), 10::BIGINT FROM options""")
def option_queries(spark: SparkSession, d: str) -> DataFrame:
    return S.option_queries(I.questions(spark, d))


MERGED = f"""
m AS (SELECT qid, id AS doc_id, max(score) AS best, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, count(DISTINCT label) AS n_labels FROM hits GROUP BY ALL),
merged AS (SELECT qid, doc_id, best, labels, n_labels, round(best + 1.25 * (n_labels - 1), 4) AS score FROM m)"""
OPTION_HITS = bm25_sql(DOCS, "SELECT concat(qid, '|', label) AS qid, query AS text FROM oq", tail=""",
hits AS (SELECT CAST(split_part(qid, '|', 1) AS BIGINT) AS qid, split_part(qid, '|', 2) AS label, id, score FROM (
  SELECT qid, id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 4) DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10),
""" + MERGED).replace("WITH d AS", f"""WITH {I.Q_CTE}, oq AS (SELECT qid, 'stem' AS label, question AS query FROM questions
  UNION ALL SELECT qid, concat('option_', option), concat(question, chr(10), option, '. ', body) FROM options), d AS""", 1)


def option_hits(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents of the stem and of every option: (qid, label, id, score)."""
    index = bm25.shared_index(table(spark, d, "documents"), "doc_id", "text")
    terms = bm25.query_terms(S.option_queries(I.questions(spark, d)), "qid", "query", T.simple_tokens, "label")
    return bm25.ranked(index, terms, "qid", 10, "label").select("qid", "label", "id", "score", "rank")


@query(OPTION_HITS + " SELECT * FROM merged")
def merge_multi_hit(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.merge_hits(option_hits(spark, d).withColumnRenamed("id", "doc_id"), ["qid", "doc_id"])


@query(OPTION_HITS + """
SELECT qid, doc_id, score, rank FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT qid, id AS doc_id, round(sum(score), 4) AS score FROM hits GROUP BY ALL)) WHERE rank <= 5""")
def option_level_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Scores of stem and options added up per document, five best."""
    added = retrieval.add_scores(option_hits(spark, d).withColumnRenamed("id", "doc_id"), ["qid", "doc_id"])
    return bm25.top_k(added, ["qid"], 5, "doc_id").select("qid", "doc_id", "score", "rank")


@query(f"""WITH {I.UNITS_CTE}
SELECT qid, unit_id, section_id, sibling_id, n FROM (
  SELECT a.doc_id AS qid, a.unit_id, a.section_id, b.unit_id AS sibling_id, row_number() OVER (PARTITION BY a.doc_id, a.unit_id ORDER BY b.ord, b.unit_id) AS n
  FROM units a JOIN units b ON a.section_id = b.section_id AND a.unit_id <> b.unit_id
  WHERE a.unit_type = 'table_row' AND (b.unit_type <> 'text' OR contains(b.text, 'License'))) WHERE n <= 4""")
def siblings_topn(spark: SparkSession, d: str) -> DataFrame:
    units = I.units(spark, d)
    anchors = units.where("unit_type = 'table_row'").select(F.col("doc_id").alias("qid"), "unit_id", "section_id")
    keep = (F.col("unit_type") != "text") | F.col("text").contains("License")
    return retrieval.siblings(anchors, units, 4, keep).select("qid", "unit_id", "section_id", "sibling_id", "n")


@query(f"""WITH {I.UNITS_CTE}, {I.SECTIONS_CTE}
SELECT u.unit_id, coalesce(s.section_path, u.text) AS section_path, s.start_ord, s.end_ord FROM units u LEFT JOIN sections s ON u.section_id = s.section_id AND s.end_ord > s.start_ord""")
def ancestry_left_join(spark: SparkSession, d: str) -> DataFrame:
    units = I.units(spark, d)
    held = I.sections(units).where("end_ord > start_ord").select("section_id", "section_path", "start_ord", "end_ord")
    return units.join(held, "section_id", "left").select("unit_id", F.coalesce("section_path", "text").alias("section_path"), "start_ord", "end_ord")


@query(f"""WITH {I.UNITS_CTE}, {I.SECTIONS_CTE},
near AS (SELECT a.doc_id AS qid, a.unit_id, b.unit_id AS sib, row_number() OVER (PARTITION BY a.doc_id, a.unit_id ORDER BY b.ord, b.unit_id) AS n
  FROM units a JOIN units b ON a.section_id = b.section_id AND a.unit_id <> b.unit_id WHERE a.unit_type = 'financial_field'),
lists AS (SELECT qid, unit_id, string_agg(sib, ',' ORDER BY n) AS siblings FROM near WHERE n <= 4 GROUP BY ALL)
SELECT a.doc_id AS qid, a.unit_id, s.section_path, s.start_ord, s.end_ord, coalesce(l.siblings, '') AS siblings
FROM units a LEFT JOIN sections s USING (section_id) LEFT JOIN lists l ON l.unit_id = a.unit_id WHERE a.unit_type = 'financial_field'""")
def evidence_pack(spark: SparkSession, d: str) -> DataFrame:
    units = I.units(spark, d)
    anchors = units.where("unit_type = 'financial_field'").select(F.col("doc_id").alias("qid"), "unit_id", "section_id")
    packs = retrieval.evidence_packs(anchors, units, I.sections(units), 4)
    return packs.select("qid", "unit_id", "section_path", "start_ord", "end_ord", F.array_join(F.transform("siblings", lambda s: s["unit_id"]), ",").alias("siblings"))


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


METRICS_SQL = ", ".join(f"CASE WHEN {_has('text', [m, *a])} THEN '{m}' END" for m, a in LATIN.metrics.items())


@query(f"""WITH p AS (SELECT item_id AS qid, list_filter([{', '.join(f"CASE WHEN {_has('text', [c, *a])} THEN '{c}' END" for c, a in LATIN.companies.items())}], lambda x: x IS NOT NULL) AS companies,
  list_distinct(regexp_extract_all(text, '20[0-9]{{2}}')) AS years, list_filter(['the ', 'tion', 'License'], lambda w: contains(text, w)) AS metrics FROM benchmark),
c AS (SELECT doc_id, text, source AS company_text, 2000 + doc_id % 30 AS year FROM documents),
s AS (SELECT qid, doc_id, CAST(10 * CAST(len(list_filter(companies, lambda x: contains(company_text, x))) > 0 AS INT) + 5 * CAST(list_contains(years, CAST(year AS VARCHAR)) AS INT) + len(list_filter(metrics, lambda m: contains(text, m))) AS BIGINT) AS score FROM p, c),
r AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, score, rank FROM r WHERE (best > 0 AND score > 0 AND rank <= 3) OR best = 0""")
def doc_routing(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ("the ", "tion", "License")))
    plans = _items(spark, d).select("qid", T.named(F.col("text"), LATIN.companies).alias("companies"), F.array_distinct(T.find_all(F.col("text"), T.YEAR)).alias("years"), F.filter(words, lambda w: F.col("text").contains(w)).alias("metrics"))
    cards = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("company_text"), (2000 + F.col("doc_id") % 30).alias("year"))
    return retrieval.route_documents(plans, cards)


@query(r"""WITH q AS (SELECT c_custkey AS qid, regexp_extract_all(concat('about ', c_custkey % 50, ' and 3.5'), '[0-9]+\.?[0-9]*')[1:5] AS nums FROM customer),
ch AS (SELECT o_custkey % 20 AS doc_id, o_orderkey AS chunk_id, list_distinct(regexp_extract_all(concat('order ', o_orderkey % 50, ' for ', o_custkey % 7, '.5'), '[0-9]+\.?[0-9]*')) AS nums FROM orders),
h AS (SELECT q.qid, c.doc_id, c.chunk_id, q.number, row_number() OVER (PARTITION BY q.qid, q.number ORDER BY c.doc_id, c.chunk_id) AS n
  FROM (SELECT qid, unnest(nums) AS number FROM q) q JOIN (SELECT doc_id, chunk_id, unnest(nums) AS number FROM ch) c USING (number) WHERE c.doc_id % 3 = q.qid % 3)
SELECT qid, doc_id, chunk_id, number, 1.0::DOUBLE AS score FROM h WHERE n <= 2""")
def number_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a question's documents that hold its numbers."""
    pattern = (r"[0-9]+\.?[0-9]*",)
    said = F.concat(F.lit("order "), F.col("o_orderkey") % 50, F.lit(" for "), F.col("o_custkey") % 7, F.lit(".5"))
    chunks = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("doc_id"), F.col("o_orderkey").alias("chunk_id"), T.numbers(said, pattern).alias("numbers"))
    scope = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint")), lambda i: i % 3 == F.col("c_custkey") % 3)
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), T.numbers(F.concat(F.lit("about "), F.col("c_custkey") % 50, F.lit(" and 3.5")), pattern).alias("numbers"), scope.alias("doc_ids"))
    return retrieval.number_hits(asked, chunks)


@query(f"""WITH {I.UNITS_CTE}, hits AS (SELECT doc_id % 10 AS qid, unit_id AS id, section_id, domain, CAST(length(text) AS DOUBLE) AS score FROM units),
wide AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS wide_rank FROM hits),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM wide WHERE wide_rank <= 150 AND domain = 'en')
SELECT qid, id, section_id, score, wide_rank, rank FROM r WHERE rank <= 5""")
def restricted_search(spark: SparkSession, d: str) -> DataFrame:
    hits = I.units(spark, d).select((F.col("doc_id") % 10).alias("qid"), F.col("unit_id").alias("id"), "section_id", "domain", F.length("text").cast("double").alias("score"))
    allowed = hits.where("domain = 'en'").select("qid", "section_id").distinct()
    return retrieval.restrict_sections(hits.drop("domain"), allowed, 5).select("qid", "id", "section_id", "score", "wide_rank", "rank")


@query("""WITH s AS (SELECT DISTINCT o_custkey % 5 AS doc_id, concat('A > ', o_orderkey % 40) AS path FROM orders),
c AS (SELECT DISTINCT 1::BIGINT AS qid, doc_id, concat('A > ', 1 + doc_id % 3) AS path FROM s)
SELECT DISTINCT c.qid, c.doc_id, s.path AS section_path FROM c JOIN s USING (doc_id) WHERE starts_with(s.path, c.path)""")
def section_expansion(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("doc_id"), F.concat(F.lit("A > "), F.col("o_orderkey") % 40).alias("path")).distinct()
    chosen = sections.select(F.lit(1).cast("bigint").alias("qid"), "doc_id", F.concat(F.lit("A > "), 1 + F.col("doc_id") % 3).alias("path")).distinct()
    return retrieval.expand_sections(chosen, sections)


@query(rf"""WITH q AS (SELECT item_id AS qid, unnest(list_distinct({TOK.format('text')})) AS term FROM benchmark),
d AS (SELECT doc_id AS id, unnest(list_distinct({TOK.format('text')})) AS term FROM documents)
SELECT qid, id, score, rank FROM (SELECT qid, id, count(*) AS score, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, id) AS rank FROM q JOIN d USING (term) GROUP BY qid, id) WHERE rank <= 5""")
def keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    asked = _items(spark, d).select("qid", F.array_distinct(T.simple_tokens(F.col("text"))).alias("terms"))
    # The index holds each text's distinct terms.
    index = bm25.shared_index(table(spark, d, "documents"), "doc_id", "text")
    terms = asked.select("qid", F.explode("terms").alias("term"), F.lit(1).cast("bigint").alias("qtf"))
    best = bm25.best(index, terms, "qid", 5, plain=True)
    if best is not None:
        return best.select("qid", "id", F.col("score").cast("bigint").alias("score"), "rank")
    docs = index.texts.select("id", F.transform("terms", lambda t: t["term"]).alias("terms"))
    return retrieval.overlap_top_k(asked, docs, 5)


@query("""SELECT DISTINCT o.o_custkey AS qid, o.o_orderpriority AS field FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = o.o_custkey AND e.o_orderstatus = 'F')""")
def evidence_gap_antijoin(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    wanted = orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("field")).distinct()
    return retrieval.missing_evidence(wanted, orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("qid")), ["qid"])


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def backoff_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.missing_evidence(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query(f"""WITH {I.LINES_CTE}, b AS (SELECT doc_id, ord, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS used FROM lines)
SELECT doc_id, ord, used FROM b WHERE used <= 1500""")
def char_budget(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.within_budget(I.lines(spark, d), "doc_id", ["ord"], F.length("line"), 1500).select("doc_id", "ord", "used")


@query(f"""WITH {I.LINES_CTE}, b AS (SELECT doc_id, ord, line, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS used FROM lines)
SELECT doc_id, ord, CASE WHEN used <= 1500 THEN line ELSE concat(substr(line, 1, CAST(1500 - (used - length(line)) AS INT)), '...') END AS line FROM b WHERE used <= 1500 OR 1500 - (used - length(line)) > 200""")
def budget_partial(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.within_budget_cut(I.lines(spark, d), "doc_id", ["ord"], "line", 1500, mark="...").select("doc_id", "ord", "line")


@query(r"""WITH r AS (SELECT source, doc_id AS id, text, n_chars AS score, contains(text, 'License') AS special,
  substr(regexp_replace(text, '[ \t-\r]+', '', 'g'), 1, 220) AS cut FROM documents),
b AS (SELECT *, CASE WHEN special AND own <= 4 THEN 0 WHEN NOT special THEN 1 ELSE 2 END AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY source, special ORDER BY score DESC, id) AS own FROM r)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, cut ORDER BY bucket, score DESC, id) AS k FROM b) WHERE k = 1)
SELECT source, id, bucket::BIGINT AS bucket, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, score DESC, id) AS place FROM o) WHERE place <= 8""")
def quota_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("score"))
    return retrieval.quota(blocks, "source", F.col("text").contains("License"), 8).select("source", "id", "bucket", "place")


def _dom(column: str, cases: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


def _named_sql(weight: float, vocabulary: dict[str, list[str]], q: str = "query", hay: str = "hay") -> str:
    return " + ".join(f"CASE WHEN {_has(q, [n, *a])} AND {_has(hay, [n, *a])} THEN {weight}::DOUBLE ELSE 0 END" for n, a in vocabulary.items())


YEARS_SQL = "len(list_filter(list_distinct(regexp_extract_all(query, '20[0-9]{2}')), lambda y: contains(hay, y)))"
NUMS_SQL = r"regexp_extract_all(query, '20[0-9]{2}|[0-9]+(?:\.[0-9]+)?%?')"
DEPTH_SQL = "least(length(path) - length(translate(path, '>/', '')), 4)"
#: Every unit scored against one question of its document.
PAIRS_CTE = I.UNITS_CTE + ", pairs AS (SELECT u.unit_id, u.unit_type AS kind, u.domain, u.text AS hay, b.text AS query, u.section_id AS path FROM units u JOIN benchmark b ON b.item_id = u.doc_id % 40)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return I.with_items(I.units(spark, d), table(spark, d, "benchmark")).select("unit_id", F.col("unit_type").alias("kind"), "domain", F.col("text").alias("hay"), "query", F.col("section_id").alias("path"))


@query(f"""WITH {PAIRS_CTE} SELECT unit_id, round({_named_sql(3.0, LATIN.metrics)} + {YEARS_SQL} * 1.2::DOUBLE + {_named_sql(1.0, LATIN.companies)}
  + CASE WHEN {_has('path', LATIN.section_priors)} THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN kind IN ('financial_field', 'table_row') THEN 1.5::DOUBLE ELSE 0 END, 4) AS boost FROM pairs""")
def domain_boost(spark: SparkSession, d: str) -> DataFrame:
    boost = scoring.domain_boost(F.col("query"), F.col("hay"), F.lit(None).cast("string"), F.col("path"), F.col("kind"), LATIN)
    return _pairs(spark, d).select("unit_id", F.round(boost, 4).alias("boost"))


@query(f"""WITH {PAIRS_CTE} SELECT unit_id, round(CASE kind WHEN 'financial_field' THEN 2.0::DOUBLE WHEN 'table_row' THEN 1.8::DOUBLE WHEN 'heading' THEN 0.3::DOUBLE ELSE 0 END + {DEPTH_SQL} * 0.15::DOUBLE
  + {_named_sql(1.0, LATIN.companies)} + {YEARS_SQL} * 0.8::DOUBLE + {_named_sql(2.2, LATIN.metrics)}
  + {_dom('domain', {k: f"least({' + '.join(f"CAST(contains(hay, '{t}') AS INT)" for t in ts)}, 3) * {w}::DOUBLE" for k, (w, ts) in LATIN.domain_keywords.items()}, '0')}
  - CASE WHEN {_has('hay', LATIN.generic_terms)} THEN 0.8::DOUBLE ELSE 0 END
  + least(len(list_filter({NUMS_SQL}, lambda n: contains(hay, n))), 3) * 0.4::DOUBLE, 4) AS score FROM pairs""")
def hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    score = scoring.hybrid_score(F.col("query"), F.col("hay"), F.lit(None).cast("string"), F.col("path"), F.col("kind"), F.col("domain"), LATIN)
    return _pairs(spark, d).select("unit_id", score.alias("score"))


@query(f"""WITH {PAIRS_CTE} SELECT unit_id, round({_named_sql(3.0, LATIN.metrics)} + {YEARS_SQL} * 1.0::DOUBLE + {_named_sql(1.0, LATIN.companies)}
  + {_dom('domain', {k: f"CASE WHEN {_has('hay', w)} THEN 1.5::DOUBLE ELSE 0 END" for k, w in LATIN.route_priors.items()}, '0')} + {DEPTH_SQL} * 0.15::DOUBLE
  + len(list_filter({NUMS_SQL}, lambda n: contains(hay, n))) * 0.4::DOUBLE, 4) AS boost FROM pairs WHERE kind = 'heading'""")
def section_routing(spark: SparkSession, d: str) -> DataFrame:
    boost = scoring.routing_boost(F.col("query"), F.col("hay"), F.col("path"), F.col("domain"), LATIN)
    return _pairs(spark, d).where("kind = 'heading'").select("unit_id", F.round(boost, 4).alias("boost"))


@query(f"""WITH {I.UNITS_CTE} SELECT unit_id, CASE WHEN {_has('text', ['License', 'licensed'])} OR ord <= 2 THEN length(text) * 1.5::DOUBLE ELSE length(text)::DOUBLE END AS score FROM units""")
def section_boost(spark: SparkSession, d: str) -> DataFrame:
    boosted = scoring.section_boost(F.length("text").cast("double"), F.col("text"), F.col("ord"), ["cover", "rights"], {"rights": ["License", "licensed"]})
    return I.units(spark, d).select("unit_id", boosted.alias("score"))


CARD_KINDS_SQL = _dom("domain", {k: "list_filter([" + ", ".join(f"CASE WHEN {_has('text', w)} THEN '{t}' END" for t, w in types.items()) + "], lambda x: x IS NOT NULL)" for k, types in LATIN.card_patterns.items()}, "[]::VARCHAR[]")
CARDS_CTE = I.UNITS_CTE + f""", cards AS (SELECT doc_id, domain, ord, text, card_type FROM (
  SELECT *, row_number() OVER (PARTITION BY domain, doc_id, card_type, substr(text, 1, 240) ORDER BY ord) AS k FROM (SELECT doc_id, domain, ord, text, unnest({CARD_KINDS_SQL}) AS card_type FROM units)) WHERE k = 1)"""


@query(f"WITH {CARDS_CTE} SELECT doc_id, domain, ord, card_type FROM cards")
def domain_cards(spark: SparkSession, d: str) -> DataFrame:
    return S.domain_cards(I.units(spark, d), LATIN.card_patterns).select("doc_id", "domain", "ord", "card_type")


CARD_TOK = r"list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z]+|20[0-9]{{2}}|[0-9]+(?:\.[0-9]+)?%?'), lambda t: lower(t)))"


@query(rf"""WITH {CARDS_CTE}, p AS (SELECT c.*, b.text AS query, {CARD_TOK.format('b.text')} AS q, {CARD_TOK.format('c.text')} AS t FROM cards c JOIN benchmark b ON b.item_id = c.doc_id % 40),
s AS (SELECT doc_id, ord, card_type, len(list_intersect(q, t)) AS shared, round(len(list_intersect(q, t)) + len(list_filter(q, lambda w: length(w) >= 3 AND contains(lower(text), w))) * 0.35::DOUBLE
  + len(list_filter(regexp_extract_all(query, '20[0-9]{{2}}'), lambda y: contains(text, y))) * 1.0::DOUBLE + len(list_filter(regexp_extract_all(query, '[0-9]+(?:\.[0-9]+)?%?'), lambda n: contains(text, n))) * 0.8::DOUBLE
  + CASE WHEN card_type = 'ListCard' AND contains(query, 'the') THEN 2.0::DOUBLE ELSE 0 END, 4) AS score FROM p)
SELECT doc_id, ord, card_type, score FROM s WHERE shared > 0 AND score >= 4.0""")
def domain_card_search(spark: SparkSession, d: str) -> DataFrame:
    cards = S.domain_cards(I.units(spark, d), LATIN.card_patterns)
    score = scoring.card_score(F.col("query"), F.col("text"), F.col("card_type"), {"ListCard": ["the"]})
    return I.with_items(cards, table(spark, d, "benchmark")).select("doc_id", "ord", "card_type", "domain", score.alias("score")).transform(search.strong_cards, []).drop("domain")


@query("""SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 3""")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).alias("score"))
    return bm25.top_k(rows, ["label"], 3, "vec_id").select("label", "vec_id", "rank")


