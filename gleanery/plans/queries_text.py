"""Queries over text functions and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.vocab import CHINESE, LATIN, QID_PREFIXES, TOKEN_BUDGET
from gleanery.operators import claims as C
from gleanery.operators import segmentation as S
from gleanery.plans import inputs as I
from gleanery.plans.registry import query
from gleanery.session import spread, table

_S = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm_sql(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(replace(translate(coalesce({x}, ''), '　 ﾠ，', '   ,'), '﻿', ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_S}+|{_S}+$', '', 'g')"
    )


def compact_sql(x: str) -> str:
    return f"regexp_replace({norm_sql(x)}, '{_S}+', '', 'g')"


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


#: A few lines of numbered headings, so that the ladder is exercised where tables have none.
HEADINGS = ("第一节 重要提示", "第十二章 附则", "目录", "一、公司信息", "（一）主要会计数据", "3.1 总体经营情况", "1. 概述", "12", "二", "第三条 内容", "1、2024年收入", "正文" * 60, "重要提示", "", "2.5亿元", "A", "(三) 其他")
_HEADINGS_SQL = "(VALUES " + ", ".join(f"({i}::BIGINT, '{h}')" for i, h in enumerate(HEADINGS)) + ") AS h(id, line)"
_N = "一二三四五六七八九十百零〇壹贰叁肆伍陆柒捌玖拾"


def _headings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(HEADINGS)), "id bigint, line string")


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS normal, length({compact_sql('text')}) AS n_compact FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normal"), F.length(T.compact(F.col("text"))).cast("bigint").alias("n_compact"))


@query("SELECT doc_id, substr(md5(text), 1, 10) AS hash FROM documents")
def stable_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.stable_hash(F.col("text")).alias("hash"))


def _noise_sql(x: str) -> str:
    t, tc = norm_sql(x), compact_sql(x)
    return f"CASE WHEN {t} = '' THEN true WHEN regexp_full_match({tc}, '[0-9]{{1,4}}') THEN true WHEN {tc} IN ('目录', '目次', '中国建筑股份有限公司', '2025年年度报告', '年度报告') THEN false WHEN length({tc}) <= 2 AND NOT regexp_matches({tc}, '[一二三四五六七八九十章节]') THEN true ELSE false END"


@query(f"WITH {I.LINES_CTE} SELECT doc_id * 100000 + ord AS id, {_noise_sql('line')} AS noise FROM lines UNION ALL SELECT -1 - id, {_noise_sql('line')} FROM {_HEADINGS_SQL}")
def noise_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = I.lines(spark, d).select((F.col("doc_id") * 100000 + F.col("ord")).alias("id"), "line").unionByName(_headings(spark).select((-1 - F.col("id")).alias("id"), "line"))
    return rows.select("id", T.is_noise_line(F.col("line")).alias("noise"))


def _level_sql(x: str) -> str:
    t, tc = norm_sql(x), compact_sql(x)
    return (
        f"CASE WHEN {t} = '' OR length({tc}) > 90 THEN NULL WHEN regexp_matches({tc}, '^第[{_N}0-9]+[章节].+') THEN 1 "
        f"WHEN {tc} IN ('董事长致辞', '行长致辞', '致股东', '致股东的信', '年报速览', '重要提示', '释义', '目录', '财务报告', '审计报告') THEN 1 "
        f"WHEN regexp_matches({tc}, '^[{_N}]+[、.．].+') THEN 2 WHEN regexp_matches({tc}, '^[（(][{_N}]+[）)].+') THEN 3 WHEN regexp_matches({tc}, '^[0-9]+(?:\\.[0-9]+)+[、.．].+') THEN 3 "
        f"WHEN regexp_matches({t}, '^[0-9]+[、.．]\\s*[^0-9].+') AND length({tc}) <= 55 THEN 4 END"
    )


@query(f"WITH {I.LINES_CTE} SELECT doc_id * 100000 + ord AS id, {_level_sql('line')} AS level FROM lines UNION ALL SELECT -1 - id, {_level_sql('line')} FROM {_HEADINGS_SQL}")
def heading_level(spark: SparkSession, d: str) -> DataFrame:
    rows = I.lines(spark, d).select((F.col("doc_id") * 100000 + F.col("ord")).alias("id"), "line").unionByName(_headings(spark).select((-1 - F.col("id")).alias("id"), "line"))
    return rows.select("id", T.heading_level(F.col("line")).alias("level"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '[0-9]+\.?[0-9]*%'), regexp_extract_all(text, '[0-9]+\.?[0-9]*[万亿]?元'),
  regexp_extract_all(text, '[0-9]+\.?[0-9]*[万亿]'), regexp_extract_all(text, '[0-9]{4}年'), regexp_extract_all(text, '[0-9]+个?[工作]*日'), regexp_extract_all(text, '[0-9]+个月'), regexp_extract_all(text, '[0-9]+\.?[0-9]*')))), ',') AS numbers FROM documents""")
def chunk_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), ",").alias("numbers"))


@query("""WITH c AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 800 THEN [0] ELSE range(0, length(text), 700) END) AS start FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_id, start::BIGINT AS start, md5(substr(text, start::INT + 1, 800)) AS chunk FROM c""")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    chunks = S.fixed_chunks(table(spark, d, "documents"), "doc_id", "text")
    return chunks.select("doc_id", "chunk_id", "start", F.md5("chunk").alias("chunk"))


@query(f"""WITH {I.UNITS_CTE} SELECT doc_id, section, coalesce(arg_min(CASE WHEN unit_type = 'heading' THEN text END, CASE WHEN unit_type = 'heading' THEN ord END), '') AS title,
  min(ord) AS first_ord, md5(string_agg(text, chr(10) ORDER BY ord)) AS body FROM units GROUP BY doc_id, section""")
def header_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = I.lines(spark, d)
    out = S.header_sections(rows, "doc_id", T.is_header(F.col("line"), I.LATIN_HEADER, I.HEADER_SHORTER_THAN))
    return out.select("doc_id", "section", "title", "first_ord", F.md5("body").alias("body"))


@query(f"WITH {I.LINES_CTE} SELECT doc_id, md5(coalesce(string_agg(line, chr(10) || chr(10) ORDER BY ord) FILTER (line <> ''), '')) AS full_text FROM lines GROUP BY doc_id")
def fulltext_rejoin(spark: SparkSession, d: str) -> DataFrame:
    return S.full_text(I.lines(spark, d), "doc_id", "ord", "line").select("doc_id", F.md5("full_text").alias("full_text"))


def _levels_cte() -> str:
    return I.LINES_CTE + ", h AS (SELECT doc_id, ord, 1 + ord % 3 AS level, line AS title FROM lines WHERE length(line) < 60)"


@query(f"""WITH RECURSIVE {_levels_cte()}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM h),
s AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 0::BIGINT AS ord, 0::BIGINT AS level, '' AS title, []::STRUCT(l BIGINT, t VARCHAR)[] AS st FROM n
  UNION ALL SELECT n.doc_id, n.k, n.ord, n.level, n.title, CASE
    WHEN len(list_filter(s.st, lambda e: e.l < n.level)) > 0 AND list_filter(s.st, lambda e: e.l < n.level)[-1].t = n.title THEN list_filter(s.st, lambda e: e.l < n.level)
    WHEN len(list_filter(s.st[-2:], lambda e: e.l = n.level AND e.t = n.title)) > 0 THEN s.st
    ELSE list_append(list_filter(s.st, lambda e: e.l < n.level), {{'l': n.level, 't': n.title}}) END
  FROM s JOIN n ON n.doc_id = s.doc_id AND n.k = s.k + 1)
SELECT doc_id, ord, CAST(level AS INT) AS level, title, array_to_string(list_transform(list_filter(st, lambda e: e.t <> ''), lambda e: e.t), ' > ') AS path FROM s WHERE k > 0""")
def section_path(spark: SparkSession, d: str) -> DataFrame:
    """Short lines stand in for headings here, as numbered ones are rare in these texts."""
    rows = I.lines(spark, d).where(F.length("line") < 60).select("doc_id", "ord", (1 + F.col("ord") % 3).alias("level"), F.col("line").alias("title"))
    return S.section_tree(rows, "doc_id")


@query(f"""WITH {_levels_cte()} SELECT doc_id, title AS path, min(level) AS level, min(ord) AS start_page, max(ord) AS end_page, substr(md5(concat_ws('|', doc_id, title)), 1, 10) AS section_id FROM h GROUP BY doc_id, title""")
def section_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = I.lines(spark, d).where(F.length("line") < 60).select("doc_id", "ord", (1 + F.col("ord") % 3).alias("level"), F.col("line").alias("path"))
    return S.section_spans(rows, "doc_id")


@query(f"""WITH RECURSIVE {I.LINES_CTE}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM lines),
s AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 0::BIGINT AS held, 0::BIGINT AS unit FROM n
  UNION ALL SELECT n.doc_id, n.k, CASE WHEN held > 1100 THEN length(line) ELSE held + length(line) + CAST(held > 0 AS INT) END, unit + CAST(held > 1100 AS INT) FROM s JOIN n ON n.doc_id = s.doc_id AND n.k = s.k + 1),
u AS (SELECT n.doc_id, s.unit, min(n.ord) AS first_ord, string_agg(n.line, chr(10) ORDER BY n.ord) AS text FROM n JOIN s ON n.doc_id = s.doc_id AND n.k = s.k GROUP BY ALL)
SELECT doc_id, unit, first_ord, md5(text) AS text FROM u WHERE length(regexp_replace(text, '\\s+', '', 'g')) >= 8""")
def text_units(spark: SparkSession, d: str) -> DataFrame:
    return S.text_units(I.lines(spark, d), "doc_id").withColumn("text", F.md5("text"))


CONTENTS_CTE = """lines AS (SELECT o_custkey AS doc_id, o_orderkey * 3 + u.i AS ord, [concat('Part ', o_orderkey % 9, ' ..... ', o_orderkey % 90), concat('Chapter of ', o_orderstatus), CAST(o_orderkey % 50 AS VARCHAR)][u.i + 1] AS line FROM orders, unnest([0, 1, 2]) AS u(i))"""


@query(f"""WITH {CONTENTS_CTE}, n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY ord) AS next, regexp_extract(line, '([0-9]{{1,4}})\\s*$', 1) AS ends FROM lines),
e AS (SELECT doc_id, ord, CASE WHEN ends <> '' THEN regexp_replace(line, '[\\s.…·]*[0-9]{{1,4}}\\s*$', '') ELSE line END AS title,
  TRY_CAST(coalesce(nullif(ends, ''), CASE WHEN regexp_matches(trim(next), '^[0-9]{{1,4}}$') THEN trim(next) END) AS BIGINT) AS page FROM n)
SELECT doc_id, title, page, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, title, page ORDER BY ord) AS k FROM e WHERE page IS NOT NULL AND title <> '') WHERE k = 1""")
def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    """Contents lines made from orders: with the page at the end, and with the page in the next line."""
    k = F.col("o_orderkey")
    three = F.array(F.concat(F.lit("Part "), k % 9, F.lit(" ..... "), k % 90), F.concat(F.lit("Chapter of "), "o_orderstatus"), (k % 50).cast("string"))
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("k"), F.posexplode(three).alias("i", "line"))
    return S.toc_entries(lines.select("doc_id", (F.col("k") * 3 + F.col("i")).alias("ord"), "line"), "doc_id")


@query(f"""WITH {I.UNITS_CTE} SELECT unit_id, last_value(CASE WHEN unit_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) AS current_heading FROM units""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    heading = F.when(F.col("unit_type") == "heading", F.col("text"))
    return S.carry_forward(I.units(spark, d), "doc_id", "ord", heading, "current_heading").select("unit_id", "current_heading")


@query()
def field_cards(spark: SparkSession, d: str) -> DataFrame:
    """Map-valued: checked on small tables in the tests."""
    rows = I.units(spark, d).select("doc_id", "ord", F.col("section_id").alias("section_path"), "text", F.lit(None).cast("string").alias("row_header"), F.lit(None).cast("string").alias("unit"))
    return S.field_cards(rows, LATIN.metrics, LATIN.section_priors)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'pdf' WHEN lang = 'fr' THEN 'txt' WHEN lang = 'de' THEN 'html' ELSE 'unknown' END AS file_type FROM documents")
def file_types(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("lang") == "en", ".PDF").when(F.col("lang") == "fr", ".txt").when(F.col("lang") == "de", ".htm").otherwise("")
    return table(spark, d, "documents").select("doc_id", T.file_type(F.concat(F.lit("raw/x.y/"), "doc_id", end)).alias("file_type"))


@query(r"""SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '_{2,}', '_', 'g'), 1, 200), '^[_. ]+|[_. ]+$', '', 'g') AS name FROM pages""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'insurance' WHEN 1 THEN 'regulatory' WHEN 2 THEN 'financial_contracts' WHEN 3 THEN 'financial_reports' WHEN 4 THEN 'research' ELSE 'unknown' END AS domain FROM orders""")
def infer_domain(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("ins_a_", "reg_b_", "fc_c_", "fin_a_", "res_", "other_")))
    qid = F.concat(F.get(names, (F.col("o_orderkey") % 6).cast("int")), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.infer_domain(qid, QID_PREFIXES).alias("domain"))


_METRICS_SQL = ", ".join(f"CASE WHEN {_has('text', [m, *a])} THEN '{m}' END" for m, a in LATIN.metrics.items())


@query(f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {_has('text', [c, *a])} THEN '{c}' END" for c, a in LATIN.companies.items())}], lambda x: x IS NOT NULL), ',') AS companies,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '20[0-9]{{2}}'))), ',') AS years, array_to_string(list_filter([{_METRICS_SQL}], lambda x: x IS NOT NULL), ',') AS metrics,
  coalesce({_METRICS_SQL}) AS canonical FROM documents""")
def query_plan(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    years = F.array_sort(F.array_distinct(T.find_all(text, T.YEAR)))
    canonical = T.canonical_metric(text, {m: [m, *a] for m, a in LATIN.metrics.items()})
    return table(spark, d, "documents").select("doc_id", F.array_join(T.named(text, LATIN.companies), ",").alias("companies"), F.array_join(years, ",").alias("years"), F.array_join(T.named(text, LATIN.metrics), ",").alias("metrics"), canonical.alias("canonical"))


@query("SELECT doc_id, array_to_string(list_concat(" + ", ".join(f"CASE WHEN {_has('text', [m, *a])} THEN {[m, *dict.fromkeys(x for x in a if x != m)]!r} ELSE []::VARCHAR[] END" for m, a in LATIN.metrics.items()) + "), ',') AS terms FROM documents")
def alias_expand(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.expand_aliases(F.col("text"), LATIN.metrics), ",").alias("terms"))


def _first_sql(kind: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{kind}:{w}'" for w in words) + " END"


FLAGS_SQL = "list_filter([" + ", ".join(_first_sql(k, w) for k, w in LATIN.risk.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH f AS (SELECT doc_id, {FLAGS_SQL} AS flags FROM documents), k AS (SELECT *, list_transform(flags, lambda f: split_part(f, ':', 1)) AS kinds FROM f)
SELECT doc_id, array_to_string(flags, ',') AS flags, CASE WHEN list_contains(kinds, 'calculation') THEN 'calculate' WHEN list_contains(kinds, 'threshold') THEN 'threshold' WHEN list_contains(kinds, 'comparison') THEN 'compare'
  WHEN list_contains(kinds, 'universal') THEN 'universal' WHEN list_contains(kinds, 'negation') THEN 'negate' ELSE 'lookup' END AS operation FROM k""")
def risk_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = C.risk_flags(F.col("text"), LATIN.risk)
    return table(spark, d, "documents").select("doc_id", F.array_join(flags, ",").alias("flags"), C.operation(flags).alias("operation"))


@query("SELECT item_id, CASE " + " ".join(f"WHEN contains(text, '{a}') THEN concat(substr(text, 1, instr(text, '{a}') - 1), '{b}', substr(text, instr(text, '{a}') + {len(a)}))" for a, b in LATIN.negations) + " ELSE text END AS counter FROM benchmark")
def counter_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", C.counter_text(F.col("text"), LATIN.negations).alias("counter"))



def proxy_sql(text: str, domain: str, terms: dict[str, list[str]] = LATIN.proxy_terms) -> str:
    own = f"CASE {domain} " + " ".join(f"WHEN '{k}' THEN list_filter({w!r}, lambda w: contains(regexp_replace({text}, '\\s+', '', 'g'), w))" for k, w in terms.items()) + " ELSE []::VARCHAR[] END"
    parts = f"list_concat(regexp_extract_all({text}, '20[0-9]{{2}}'), regexp_extract_all({text}, '[0-9]+(?:\\.[0-9]+)?\\s*%|[0-9]+(?:\\.[0-9]+)?\\s*(?:日|天|年|个月|亿元|万元|元|倍|家|只|项)'), regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9.-]+'), {own})"
    # Keeps the first of equal ones, in order.
    return f"list_transform(list_filter(list_zip({parts}, range(len({parts}))), lambda z: list_position({parts}, z[1]) = z[2] + 1), lambda z: z[1])[1:30]"


@query(f"SELECT item_id, array_to_string({proxy_sql('text', chr(39) + 'en' + chr(39))}, ',') AS terms FROM benchmark")
def proxy_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = T.proxy_terms(F.col("text"), F.lit("en"), LATIN.proxy_terms, [])
    return table(spark, d, "benchmark").select("item_id", F.array_join(terms, ",").alias("terms"))


COVERAGE_CTE = f"""p AS (SELECT d.doc_id, d.lang, {proxy_sql('b.text', 'd.lang')} AS terms, regexp_replace(d.text, '\\s+', '', 'g') AS hay FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
cov AS (SELECT doc_id, lang, round(CASE WHEN len(terms) = 0 THEN 0 ELSE len(list_filter(terms, lambda t: contains(hay, regexp_replace(t, '\\s+', '', 'g')))) / len(terms)::DOUBLE END, 4) AS coverage,
  len(list_filter(terms, lambda t: regexp_matches(t, '[0-9]') AND NOT contains(hay, regexp_replace(t, '\\s+', '', 'g')))) = 0 AS numeric_ok FROM p)"""


def coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("hay")))
    rows = I.with_items(docs, table(spark, d, "benchmark")).withColumnRenamed("hay", "text")
    share, ok = T.proxy_coverage(T.proxy_terms(F.col("query"), F.col("lang"), LATIN.proxy_terms, []), F.col("text"))
    return rows.select("doc_id", "lang", F.round(share, 4).alias("coverage"), ok.alias("numeric_ok"))


@query(f"WITH {COVERAGE_CTE} SELECT doc_id, coverage, numeric_ok, coverage >= 0.5 AND numeric_ok AS hit FROM cov")
def proxy_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage(spark, d).select("doc_id", "coverage", "numeric_ok", ((F.col("coverage") >= 0.5) & F.col("numeric_ok")).alias("hit"))


@query(f"WITH {COVERAGE_CTE} SELECT lang, count(*) AS n, count(*) FILTER (coverage >= 0.3) AS n_hit, round(count(*) FILTER (coverage >= 0.3) / count(*)::DOUBLE, 4) AS rate FROM cov GROUP BY ROLLUP (lang)")
def proxy_recall_rollup(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.operators.evaluation import rates

    return rates(coverage(spark, d), "lang", F.col("coverage") >= 0.3)


@query(f"WITH {I.Q_CTE} SELECT qid, string_agg(concat(option, '. ', body), chr(10) ORDER BY option) AS options FROM options GROUP BY qid")
def format_options(spark: SparkSession, d: str) -> DataFrame:
    return I.questions(spark, d).select("qid", T.format_options(F.col("options")).alias("options"))


@query(f"""WITH {I.UNITS_CTE} SELECT unit_id, concat_ws(chr(10), CASE WHEN domain <> '' THEN concat('domain: ', domain) END, CASE WHEN section_id <> '' THEN concat('section: ', section_id) END, CASE WHEN text <> '' THEN concat('text: ', substr(text, 1, 900)) END) AS block,
  concat_ws('::', doc_id, CASE WHEN unit_type = 'text' THEN substr(md5(text), 1, 16) ELSE unit_id END) AS evidence_id FROM units""")
def evidence_rendering(spark: SparkSession, d: str) -> DataFrame:
    block = T.render_fields([("domain", F.col("domain")), ("section", F.col("section_id")), ("text", F.col("text"))], {"text": 900})
    key = T.evidence_id(F.col("doc_id").cast("string"), F.when(F.col("unit_type") != "text", F.col("unit_id")), otherwise=F.col("text"))
    return I.units(spark, d).select("unit_id", block.alias("block"), key.alias("evidence_id"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'none') AS title, coalesce(nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), ''), 'none') AS lang,
  len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages""")
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda p: F.coalesce(F.nullif(F.regexp_extract("html", p, 1), F.lit("")), F.lit("none"))
    return table(spark, d, "pages").select("page_id", pick("<title>([^<]*)</title>").alias("title"), pick('<html lang="([a-z]+)"').alias("lang"), F.size(T.find_all(F.col("html"), "<p>")).cast("bigint").alias("n_paragraphs"))


STRIP = ((r"(?s)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>", " "), (r"(?s)<!--.*?-->", " "), (r"</?(p|h1|h2|h3|div|li|article|br)[^>]*>", "\n"), (r"<[^>]*>", ""))


def _strip_sql() -> str:
    out = "html"
    for p, r in STRIP:
        put = "chr(10)" if r == "\n" else f"'{r}'"
        out = f"regexp_replace({out}, '{p}', {put}, 'g')"
    return out


@query(f"""WITH t AS (SELECT page_id, string_split({_strip_sql()}, chr(10)) AS parts FROM pages), b AS (SELECT page_id, u.i AS i, trim(parts[u.i]) AS line FROM t, unnest(range(1, len(parts) + 1)) AS u(i))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS seq, md5(line) AS block FROM b WHERE line <> ''""")
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks of pages with markup stripped by patterns, blank ones dropped."""
    from gleanery.sources.files import html_blocks

    return html_blocks(table(spark, d, "pages"), "page_id", "html").select("page_id", "seq", F.md5("line").alias("block"))


@query(f"SELECT event_id, round(CASE WHEN t <= 0 THEN 0 ELSE greatest(0, least(1, ({TOKEN_BUDGET} - t) / {TOKEN_BUDGET}::DOUBLE)) END, 6) AS score FROM (SELECT event_id, CAST(floor(value * 20000) AS BIGINT) AS t FROM events)")
def token_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(T.token_score(F.floor(F.col("value") * 20000).cast("bigint"), TOKEN_BUDGET), 6).alias("score"))


@query("SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 5 WHEN 0 THEN '基本每股收益' WHEN 1 THEN '营业收入' WHEN 2 THEN '研发投入' WHEN 3 THEN '加权平均净资产收益率' END AS metric FROM nation")
def canonical_metric(spark: SparkSession, d: str) -> DataFrame:
    """The Chinese vocabulary on a few fixed texts."""
    texts = F.array(*map(F.lit, ("2024年基本每股收益为1.2元", "营业总收入增长", "研发费用合计", "ROE 12%", "没有指标")))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.get(texts, (F.col("n_nationkey") % 5).cast("int")).alias("text"))
    return rows.select("id", T.canonical_metric(F.col("text"), CHINESE.metrics).alias("metric"))
