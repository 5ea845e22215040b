"""From texts to blocks, chunks, lines, sections, units and cards. Order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from gleanery.functions import text as T
from gleanery.operators.folds import scan


def fixed_chunks(blocks: DataFrame, doc: str, text: str, size: int = 800, overlap: int = 100, *order: str) -> DataFrame:
    """(doc, chunk_id, start, chunk). A long block gives a chunk at every step while the start lies inside it."""
    length = F.length(text)
    starts = F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), length - 1, F.lit(size - overlap)))
    rows = blocks.select(doc, *order, text, F.explode(starts).alias("start"))
    number = F.row_number().over(Window.partitionBy(doc).orderBy(*order, "start")) - 1
    return rows.select(doc, number.cast("bigint").alias("chunk_id"), F.col("start").cast("bigint").alias("start"), F.substring(text, F.col("start") + 1, F.lit(size)).alias("chunk"))


def lines_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, ord, line)"""
    return docs.select(doc, F.posexplode(F.split(F.col(text), "\n", -1)).alias("ord", "line")).withColumn("ord", F.col("ord").cast("bigint"))


def header_sections(lines: DataFrame, doc: str, header: Column) -> DataFrame:
    """(doc, section, title, first_ord, body): a header line opens a section that includes it."""
    opened = F.sum(header.cast("bigint")).over(Window.partitionBy(doc).orderBy("ord"))
    marked = lines.withColumn("section", opened).withColumn("head", header)
    return marked.groupBy(doc, "section").agg(
        F.coalesce(F.min_by(F.when(F.col("head"), F.col("line")), "ord"), F.lit("")).alias("title"),
        F.min("ord").alias("first_ord"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("body"),
    )


def full_text(blocks: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Blocks of a document joined by an empty line, empty ones left out."""
    rows = F.filter(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text] != "")
    return blocks.groupBy(doc).agg(F.array_join(F.transform(rows, lambda x: x[text]), "\n\n").alias("full_text"))


def carry_forward(rows: DataFrame, doc: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value there was, up to and including this row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(doc).orderBy(order)))


def section_tree(headings: DataFrame, doc: str) -> DataFrame:
    """(doc, ord, level, title, path) of headings (doc, ord, level, title): a stack carried from heading to heading.

    Levels at or below the new one are popped; a heading equal to the one it would stand under
    opens nothing, nor does one that repeats one of the last two entries.
    """
    def step(stack: tuple[tuple[int, str], ...], level: int, title: str):
        above = tuple(e for e in stack if e[0] < level)
        if above and above[-1][1] == title:
            stack = above
        elif (level, title) not in stack[-2:]:
            stack = (*above, (level, title))
        return stack, " > ".join(t for _, t in stack if t)

    rows = headings.select(doc, "ord", F.col("level").cast("int").alias("level"), F.coalesce("title", F.lit("")).alias("title"))
    return scan(rows, [doc], ["ord"], ["level", "title"], tuple, step, "path", StringType())


def section_spans(tree: DataFrame, doc: str, page: str = "ord") -> DataFrame:
    """Sections by path: equal paths are one section from its first to its last page."""
    return tree.groupBy(doc, "path").agg(F.min("level").cast("bigint").alias("level"), F.min(page).alias("start_page"), F.max(page).alias("end_page"), F.substring(F.md5(F.concat_ws("|", F.col(doc).cast("string"), "path")), 1, 10).alias("section_id"))


def text_units(lines: DataFrame, *group: str, most: int = 1100, least: int = 8) -> DataFrame:
    """Lines (group..., ord, line) buffered into units: a unit ends once it is longer than ``most``."""
    def step(state: tuple[int, int], size: int):
        held, unit = state
        if held > most:
            state = size, unit + 1
        else:
            state = held + size + (held > 0), unit
        return state, state[1]

    rows = lines.select(*group, "ord", "line", F.length("line").alias("size"))
    flat = scan(rows, list(group), ["ord"], ["size"], lambda: (0, 0), step, "unit", LongType())
    joined = flat.groupBy(*group, "unit").agg(F.min("ord").alias("first_ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return joined.where(F.length(T.compact(F.col("text"))) >= least)


def toc_pages(lines: DataFrame, doc: str, page: str, word: str = "目录", last_page: int = 12) -> DataFrame:
    """Pages that look like a table of contents."""
    level = T.heading_level(F.col("line"))
    return lines.groupBy(doc, page).agg(
        F.bool_or(F.col("line").contains(word)).alias("named"),
        F.count_if(level.isNotNull()).alias("headings"),
        F.count_if(F.trim("line").rlike("^[0-9]{1,4}$")).alias("numbers"),
    ).where(F.col("named") & (F.col(page) <= last_page) & (F.col("headings") >= 4) & (F.col("numbers") >= 4)).select(doc, page)


def toc_entries(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, title, page): the page stands at the end of the line or alone in the next one; first of each pair."""
    following = F.lead("line").over(Window.partitionBy(doc).orderBy("ord"))
    ends = F.regexp_extract("line", r"([0-9]{1,4})\s*$", 1)
    title = F.regexp_replace("line", r"[\s.…·]*[0-9]{1,4}\s*$", "")
    rows = lines.withColumn("next", following).select(
        doc, "ord", F.when(ends != "", title).otherwise(F.col("line")).alias("title"),
        F.coalesce(F.nullif(ends, F.lit("")), F.when(F.trim("next").rlike("^[0-9]{1,4}$"), F.trim("next"))).try_cast("bigint").alias("page"),
    ).where("page is not null and title != ''")
    return keep_first(rows, [doc, "title", "page"], "ord").select(doc, "title", "page", "ord")


def keep_first(rows: DataFrame, by: list[str], *order: str | Column) -> DataFrame:
    """The first row of each group; never dropDuplicates, which has no order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def table_units(cells: DataFrame, table: str) -> DataFrame:
    """Rows of tables (table, row, cells array): the table as Markdown and a value map for each row.

    The second row is a header too if it holds a year or an adjustment, or if neither of the first two holds a
    value. Of equal headers the last value wins.
    """
    rows = F.array_sort(F.collect_list(F.struct("row", "cells")))
    whole = cells.groupBy(table).agg(F.transform(rows, lambda r: r["cells"]).alias("rows")).where(F.size("rows") >= 2)
    line = lambda i: F.array_join(F.get("rows", F.lit(i)), " ")
    second = line(1).rlike(T.YEAR) | line(1).contains("调整") | (~line(0).rlike(T.VALUE) & ~line(1).rlike(T.VALUE))
    heads = F.when(second, 2).otherwise(1)
    whole = whole.withColumn("heads", heads).withColumn("width", F.array_max(F.transform("rows", F.size)))
    whole = whole.withColumn("headers", T.column_headers(F.slice("rows", F.lit(1), F.col("heads")), F.col("width"))).withColumn("markdown", T.markdown_table(F.slice("rows", 1, 121)))
    body = whole.select(table, "markdown", "headers", F.posexplode(F.slice("rows", F.col("heads") + 1, F.size("rows"))).alias("at", "cells"))

    def last_wins(headers, values):
        pairs = F.filter(F.zip_with(headers, values, lambda h, v: F.struct(h.alias("key"), v.alias("value"))), lambda p: F.coalesce(p["value"], F.lit("")) != "")
        alone = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
        return F.map_from_entries(alone)

    return body.select(table, F.col("at").cast("bigint").alias("row"), F.get("cells", F.lit(0)).alias("row_header"), last_wins(F.slice("headers", 2, 1 << 30), F.slice("cells", 2, 1 << 30)).alias("values"), "markdown")


def field_cards(units: DataFrame, metrics: dict[str, list[str]], priors: list[str]) -> DataFrame:
    """Units (doc_id, ord, section_path, text, row_header, unit) that name a metric, as cards with a value map.

    Values are paired with the years of the text while both last; the rest is named v1, v2 ...
    Of units alike in metric, section and first 80 characters the first stays.
    """
    header = T.canonical_metric(F.coalesce("row_header", F.lit("")), metrics)
    rows = units.withColumn("metric", F.coalesce(header, T.canonical_metric(F.col("text"), metrics))).where("metric is not null")
    rows = rows.withColumn("years", F.array_distinct(T.find_all(F.col("text"), T.YEAR))).withColumn("values", F.filter(T.find_all(F.col("text"), r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?%?"), lambda v: ~v.rlike("^20[0-9]{2}$")))
    keys = F.transform("values", lambda v, i: F.coalesce(F.get("years", i), F.concat(F.lit("v"), (i + 1 - F.least(F.size("years"), F.size("values"))).cast("string"))))
    sure = F.least(F.lit(0.95), F.when(F.coalesce("row_header", F.lit("")) != "", 0.75).otherwise(0.58) + F.when(F.col("unit").isNotNull(), 0.05).otherwise(0.0) + F.when(T.contains_any(F.col("section_path"), priors), 0.05).otherwise(0.0))
    first = keep_first(rows.withColumn("__cut", F.substring("text", 1, 80)), ["doc_id", "metric", "section_path", "__cut"], "ord")
    return first.select("doc_id", "ord", "metric", F.map_from_arrays(keys, F.col("values")).alias("value_map"), F.round(sure, 2).alias("confidence"), "section_path")


def domain_cards(units: DataFrame, patterns: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Units (doc_id, domain, ord, text) as one card per card type whose words they hold; first of equal ones."""
    kinds = F.array().cast("array<string>")
    for domain, types in patterns.items():
        own = F.array_compact(F.array(*(F.when(T.contains_any(F.col("text"), words), F.lit(kind)) for kind, words in types.items())))
        kinds = F.when(F.col("domain") == domain, own).otherwise(kinds)
    rows = units.select("doc_id", "domain", "ord", "text", F.explode(kinds).alias("card_type")).withColumn("__cut", F.substring("text", 1, 240))
    return keep_first(rows, ["domain", "doc_id", "card_type", "__cut"], "ord").drop("__cut")


def regulatory_sections(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, ord, line, chapter, section, article): numbered headings of a rule text carried forward.

    A chapter or appendix ends section and article; a section ends the article and keeps the chapter.
    """
    numeral = "[一二三四五六七八九十百零〇0-9]+"
    chapter = F.col("line").rlike(f"^第{numeral}章|^附[录件]")
    section = F.col("line").rlike(f"^第{numeral}节")
    article = F.col("line").rlike(f"^第{numeral}条")
    order = Window.partitionBy(doc).orderBy("ord")
    rows = lines.withColumn("__c", F.sum(chapter.cast("int")).over(order))
    in_chapter = Window.partitionBy(doc, "__c").orderBy("ord")
    rows = rows.withColumn("chapter", F.last(F.when(chapter, F.col("line")), ignorenulls=True).over(in_chapter)).withColumn("section", F.last(F.when(section, F.col("line")), ignorenulls=True).over(in_chapter)).withColumn("__s", F.sum(section.cast("int")).over(in_chapter))
    in_section = Window.partitionBy(doc, "__c", "__s").orderBy("ord")
    name = F.regexp_extract("line", f"^(第{numeral}条)", 1)
    return rows.withColumn("article", F.last(F.when(article, name), ignorenulls=True).over(in_section)).drop("__c", "__s")


def option_queries(questions: DataFrame, stem_k: int = 10, option_k: int = 10, stem: bool = True) -> DataFrame:
    """Questions (qid, question, options map) as the query table (qid, label, query, topk)."""
    options = questions.select("qid", "question", F.explode(F.map_entries("options")).alias("o"))
    rows = options.select("qid", F.concat(F.lit("option_"), F.col("o.key")).alias("label"), F.concat("question", F.lit("\n"), F.col("o.key"), F.lit(". "), F.col("o.value")).alias("query"), F.lit(option_k).cast("bigint").alias("topk"))
    whole = questions.select("qid", F.lit("stem").alias("label"), F.col("question").alias("query"), F.lit(stem_k).cast("bigint").alias("topk"))
    return whole.unionByName(rows) if stem else rows
