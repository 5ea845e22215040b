"""Parsers of documents that depend on the order of lines: cards, field lines, image stubs, grouped paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.planning import infer_unit


def document_cards(pages: DataFrame, companies: dict[str, list[str]], first_pages: int = 4, within: int = 1200) -> DataFrame:
    """Pages (doc_id, page, text) as (doc_id, title, company, year, page_count) from the first ones."""
    counted = pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("page") <= first_pages, F.struct("page", "text")))), lambda x: x["text"]), "\n").alias("raw"),
    ).withColumn("t", T.normalize_text(F.col("raw")))
    report = r"([^\n]{2,80}?(?:股份有限公司|有限公司))\s*(20[0-9]{2})\s*年(?:度)?报告"
    none = lambda c: F.nullif(c, F.lit(""))
    named = T.canonical_metric(F.substring("t", 1, within), companies)
    loose = none(F.regexp_extract("t", r"([\x{4e00}-\x{9fff}A-Za-z（）()]{2,50}(?:股份有限公司|有限公司))", 1))
    exact = none(F.regexp_extract("t", report, 1))
    company = F.coalesce(F.trim(exact), named, loose, F.lit(""))
    year = F.coalesce(*(none(F.regexp_extract("t", p, n)) for p, n in ((report, 2), (r"(20[0-9]{2})\s*年(?:度)?报告", 1), (r"年度报告\s*(20[0-9]{2})", 1)))).cast("bigint")
    title = F.when((company != "") & year.isNotNull(), F.concat(company, year.cast("string"), F.lit("年度报告"))).otherwise(F.col("doc_id").cast("string"))
    return counted.select("doc_id", title.alias("title"), company.alias("company"), year.alias("year"), "page_count")


def image_stubs(pages: DataFrame, least: int = 80) -> DataFrame:
    """Pages (doc_id, page, text, images) that have images or little text."""
    size = F.length(T.compact(F.col("text")))
    rows = pages.withColumn("text_len", size.cast("bigint")).where((F.col("images") > 0) | (F.col("text_len") < least))
    return rows.select("doc_id", "page", "text_len", F.lit("page_image_stub").alias("unit_type"))


#: Words of lines that belong to a metric though they hold no value, and that stand for a value.
LABELS = ("调整后", "调整前", "同期增减", "本期比上年", "本年比上年", "第一季度", "第二季度", "第三季度", "第四季度", "不适用", "适用", "不实施", "不以")
NO_VALUE = ("不实施", "不以", "不送红股")


def field_lines(lines: DataFrame, metrics: dict[str, list[str]], ahead: int = 9, labels: tuple[str, ...] = LABELS, plain: tuple[str, ...] = NO_VALUE, short: int = 22, least: int = 8) -> DataFrame:
    """Lines (doc_id, page, ord, line) that name a metric, with the values in up to ``ahead`` lines after them:
    (doc_id, page, ord, metric, raw_metric, text, unit).

    Each line sees the ``ahead`` lines after it through a window. A run of them belongs to it: up to a heading, or a
    line (not the very next) that names a metric and no value; of the run, lines with a value, a year, a label, or
    ``short`` characters at most are taken. What comes out as a unit has a value (or a word for none). Units are
    chosen in order: the next one begins no earlier than the last line but one that the run before it looked at.
    """
    names = sorted({a for al in metrics.values() for a in al}, key=lambda a: (-len(a), a))
    metric_pattern = "|".join(f"\\Q{a}\\E" for a in names)
    of = F.create_map(*(F.lit(x) for a in names for x in (a, next(m for m, al in metrics.items() if a in al))))
    page = Window.partitionBy("doc_id", "page").orderBy("ord")
    line = F.col("line")
    seen = lines.select(
        "doc_id", "page", "ord", T.normalize_text(line).alias("line"), T.heading_level(line).isNotNull().alias("heading"), F.length(T.compact(line)).alias("size"),
    ).withColumn("raw_metric", F.regexp_extract("line", metric_pattern, 0)).withColumn("valued", line.rlike(T.VALUE))
    about = F.struct(
        "line", (line != "").alias("said"), ((line != "") & F.col("heading")).alias("heading"), ((F.col("raw_metric") != "") & ~F.col("valued")).alias("other"),
        (F.col("valued") | line.rlike(T.YEAR) | T.contains_any(line, labels) | (F.col("size") <= short)).alias("kept"),
    )
    near = seen.withColumn("place", F.row_number().over(page)).withColumn("near", F.collect_list(about).over(page.rowsBetween(1, ahead))).where("raw_metric != ''")
    # The first line that ends the run, counted from 1; behind the last one if none does.
    ends = F.array_position(F.transform("near", lambda x, i: x["heading"] | ((i > 0) & x["said"] & x["other"])), True)
    run = near.withColumn("stop", F.when(ends > 0, ends).otherwise(F.size("near") + 1).cast("int"))
    taken = F.transform(F.filter(F.slice("near", F.lit(1), F.col("stop") - 1), lambda x: x["said"] & x["kept"]), lambda x: x["line"])
    units = run.withColumn("text", F.array_join(F.concat(F.array("line"), taken), "；"))
    units = units.where((F.col("text").rlike(T.VALUE) | T.contains_any(F.col("text"), plain)) & (F.length(T.compact(F.col("text"))) >= least))
    free = F.greatest(F.col("place") + 1, F.col("place") + F.col("stop") - 1).alias("free")
    unit = F.struct("place", free, "ord", "raw_metric", "text")
    # A page's units are few; the fold keeps those that begin where the one kept before them left off, or later.
    pages = units.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    kind = pages.schema["units"].dataType
    chosen = F.aggregate(
        "units", F.array().cast(kind),
        lambda acc, u: F.when((F.size(acc) == 0) | (u["place"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["free"], F.lit(0))), F.concat(acc, F.array(u))).otherwise(acc),
    )
    flat = pages.select("doc_id", "page", F.explode(chosen).alias("u"))
    return flat.select("doc_id", "page", "u.ord", F.element_at(of, F.col("u.raw_metric")).alias("metric"), "u.raw_metric", "u.text", infer_unit(F.col("u.text")).alias("unit"))


def clean_paragraphs(paragraphs: DataFrame, noise: list[str], short: int = 50, least: int = 3) -> DataFrame:
    """Paragraphs (doc_id, ord, text) without repeats of the one before, tiny ones, and short ones of navigation."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("ord"))
    once = paragraphs.withColumn("__before", before).where(~F.col("text").eqNullSafe(F.col("__before"))).drop("__before")
    return once.where((F.length("text") >= least) & ~(T.contains_any(F.col("text"), noise) & (F.length("text") < short)))


def section_preview(units: DataFrame, enough: int = 900, most: int = 1200) -> DataFrame:
    """Units (section_id, ord, unit_id, text) as the section's unit ids in order and a preview that grows until it is
    ``enough`` characters and is cut at ``most``."""
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("section_id").orderBy("ord", "unit_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = units.withColumn("shown", before < enough)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "unit_id", F.when(F.col("shown"), F.col("text")).alias("text"))))
    return rows.groupBy("section_id").agg(
        F.transform(ordered, lambda x: x["unit_id"]).alias("unit_ids"),
        F.substring(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n"), 1, most).alias("preview"),
    )


def embed_texts(texts: DataFrame, embed, batch: int = 20, most: int = 2000, dimension: int = 64, attempts: int = 3) -> DataFrame:
    """Texts (id, text) with a vector from ``embed`` (a list of strings to a list of vectors).

    Texts are cut at ``most`` characters and sent ``batch`` at a time; a batch that fails every attempt
    gets zero vectors. A model call has no built-in form, so this runs Python on batches.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for part in batches:
            vectors = []
            for at in range(0, len(part), batch):
                cut = [(t or "")[:most] for t in part["text"].iloc[at : at + batch]]
                for k in range(attempts):
                    try:
                        got = [list(map(float, v)) for v in embed(cut)]
                        break
                    except Exception:  # noqa: BLE001 - counted as an attempt
                        got = [[0.0] * dimension for _ in cut]
                        if k + 1 < attempts:
                            time.sleep(2 ** (k + 1))
                vectors += got
            yield pd.DataFrame({"id": part["id"], "vec": vectors})

    return texts.select("id", "text").mapInPandas(run, f"id {texts.schema['id'].dataType.simpleString()}, vec array<float>")
