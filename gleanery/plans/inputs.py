"""Tables of questions, units and states that queries derive from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.session import is_small, spread, table

#: A short line that ends with a point opens a section in Latin texts.
LATIN_HEADER = r"^[^ ]+( [^ ]+){0,2}\.$"
HEADER_SHORTER_THAN = 50


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("domain"), "source")


def with_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, ...) with ``query``, the text of the benchmark item that their document is dealt: items in the
    order of their ids, one document after the other, so that each item has its share of the documents."""
    n, least, most = items.agg(F.count("item_id"), F.min("item_id"), F.max("item_id")).first()
    numbered = items.select("item_id", F.col("text").alias("query"))
    if n and most - least + 1 == n == items.select("item_id").distinct().count():
        numbered = numbered.withColumn("__item", F.col("item_id") - least)
    else:  # ids with gaps
        numbered = numbered.where("item_id is not null").withColumn("__item", F.row_number().over(Window.orderBy("item_id")).cast("bigint") - 1)
    asked = numbered.select("__item", "query")
    return rows.withColumn("__item", F.pmod("doc_id", F.lit(n or 1))).join(F.broadcast(asked) if is_small(asked) else asked, "__item").drop("__item")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items with four options: the quarters of their words."""
    words = F.split("question", " ", -1)
    n = F.size("w")
    cut = lambda k: F.array_join(F.slice("w", F.floor(n * k / 4).cast("int") + 1, (F.floor(n * (k + 1) / 4) - F.floor(n * k / 4)).cast("int")), " ")
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")).withColumn("w", words)
    pairs = [x for k, name in enumerate("ABCD") for x in (F.lit(name), cut(k))]
    return rows.select("qid", "question", F.create_map(*pairs).alias("options"))


Q_CTE = """questions AS (
  SELECT item_id AS qid, text AS question, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n FROM benchmark),
options AS (
  SELECT qid, question, k.name AS option, array_to_string(w[(n * k.i) // 4 + 1 : (n * (k.i + 1)) // 4], ' ') AS body
  FROM questions, (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D')) AS k(i, name))"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    return docs.select("doc_id", F.col("lang").alias("domain"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "line")).withColumn("ord", F.col("ord").cast("bigint"))


LINES_CTE = """lines AS (
  SELECT doc_id, lang AS domain, u.i - 1 AS ord, parts[u.i] AS line
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i))"""


def units(spark: SparkSession, d: str) -> DataFrame:
    """Lines as evidence units of sections that header lines open."""
    rows = lines(spark, d)
    head = T.is_header(F.col("line"), LATIN_HEADER, HEADER_SHORTER_THAN)
    rows = rows.withColumn("section", F.sum(head.cast("bigint")).over(Window.partitionBy("doc_id").orderBy("ord")))
    kind = F.when(head, "heading").when(F.col("line").contains(" | "), "table_row").when(F.col("line").contains(" = "), "financial_field").otherwise("text")
    named = rows.select("doc_id", "domain", "ord", F.col("line").alias("text"), kind.alias("unit_type"), "section")
    return named.select(
        F.concat_ws(":", "doc_id", "ord").alias("unit_id"), F.concat_ws("/", "doc_id", "section").alias("section_id"), "doc_id", "domain", "ord", "text", "unit_type", "section"
    )


UNITS_CTE = LINES_CTE + r""",
heads AS (SELECT *, regexp_matches(line, '^[^ ]+( [^ ]+){0,2}\.$') AND length(line) < 50 AS head FROM lines),
units0 AS (SELECT doc_id, domain, ord, line AS text,
    CASE WHEN head THEN 'heading' WHEN contains(line, ' | ') THEN 'table_row' WHEN contains(line, ' = ') THEN 'financial_field' ELSE 'text' END AS unit_type,
    CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS section FROM heads),
units AS (SELECT concat(doc_id, ':', ord) AS unit_id, concat(doc_id, '/', section) AS section_id, * FROM units0)"""


def sections(rows: DataFrame) -> DataFrame:
    """Sections of units: path is the first line."""
    return rows.groupBy("doc_id", "section_id").agg(F.min_by("text", "ord").alias("section_path"), F.min("ord").alias("start_ord"), F.max("ord").alias("end_ord"))


SECTIONS_CTE = "sections AS (SELECT doc_id, section_id, arg_min(text, ord) AS section_path, min(ord) AS start_ord, max(ord) AS end_ord FROM units GROUP BY ALL)"


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Four options per question with a status and a confidence, from documents' ids and lengths."""
    x = F.col("n_chars") + F.col("doc_id")
    status = F.when(x % 3 == 0, "supported").when(x % 3 == 1, "contradicted").otherwise("mixed")
    kind = F.when(F.col("qid") % 3 == 0, "multi").when(F.col("qid") % 3 == 1, "mcq").otherwise("tf")
    rows = table(spark, d, "documents").select(F.expr("doc_id div 4").alias("qid"), F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1)).alias("option"), status.alias("status"), ((F.col("n_chars") * 7 % 101) / 100).alias("confidence"), (F.col("n_chars") % 2 == 0).alias("risky"), "text")
    return rows.withColumn("answer_format", kind)


CLAIMS_CTE = """claims AS (SELECT *, CASE qid % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'mcq' ELSE 'tf' END AS answer_format FROM (
  SELECT doc_id // 4 AS qid, substr('ABCD', CAST(doc_id % 4 + 1 AS INT), 1) AS option,
    CASE (n_chars + doc_id) % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' ELSE 'mixed' END AS status,
    (n_chars * 7 % 101) / 100.0::DOUBLE AS confidence, n_chars % 2 = 0 AS risky, text FROM documents))"""


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Letters that the turns of a conversation answer with, a round per turn."""
    rows = table(spark, d, "conversations")
    letter = F.substring(F.lit("ABCD"), (F.length("text") % 4 + 1).cast("int"), F.lit(1))
    more = F.substring(F.lit("ABCD"), (F.length("text") % 3 + 1).cast("int"), F.lit(1))
    answer = F.when(letter == more, letter).otherwise(F.concat(F.least(letter, more), F.greatest(letter, more)))
    return rows.select(F.col("conv_id").alias("qid"), F.col("turn").alias("round"), answer.alias("answer"))


VOTES_CTE = """votes AS (SELECT qid, round, CASE WHEN a = b THEN a ELSE concat(least(a, b), greatest(a, b)) END AS answer FROM (
  SELECT conv_id AS qid, turn AS round, substr('ABCD', CAST(length(text) % 4 + 1 AS INT), 1) AS a, substr('ABCD', CAST(length(text) % 3 + 1 AS INT), 1) AS b FROM conversations))"""


def results(spark: SparkSession, d: str) -> DataFrame:
    """Run results per event: domain is the type, tokens come from the value."""
    prompt = F.floor(F.abs("value") * 10).cast("bigint")
    done = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("event_id") % 13)
    rows = table(spark, d, "events").select(F.col("event_id").alias("qid"), F.col("event_type").alias("domain"), prompt.alias("prompt_tokens"), done.alias("completion_tokens"))
    return rows.withColumn("total_tokens", F.col("prompt_tokens") + F.coalesce("completion_tokens", F.lit(0))).withColumn("answer", F.substring(F.lit("ABCD"), (F.col("qid") % 4 + 1).cast("int"), F.lit(1)))


RESULTS_CTE = """results AS (SELECT *, prompt_tokens + coalesce(completion_tokens, 0) AS total_tokens, substr('ABCD', CAST(qid % 4 + 1 AS INT), 1) AS answer FROM (
  SELECT event_id AS qid, event_type AS domain, CAST(floor(abs(value) * 10) AS BIGINT) AS prompt_tokens, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 13 END AS completion_tokens FROM events))"""


def predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predicted letters of documents and gold letters from labels."""
    docs = table(spark, d, "documents")
    predicted = docs.select(F.col("doc_id").alias("qid"), F.col("lang").alias("domain"), F.when(F.col("n_chars") >= 800, "A").otherwise("B").alias("answer"))
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("qid"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("answer"))
    return predicted, gold


PRED_CTE = """predicted AS (SELECT doc_id AS qid, lang AS domain, CASE WHEN n_chars >= 800 THEN 'A' ELSE 'B' END AS answer FROM documents),
gold AS (SELECT doc_id AS qid, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS answer FROM labels)"""
