"""Files as blocks: questions, texts, pages, PDFs through a decoder, caches, answers.

A block is (doc_id, domain, seq, page_num, section_title, text).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import segmentation as S

QUESTION = "qid string, question string, options map<string,string>, answer_format string, type string, doc_ids array<string>, doc_id string, domain string, split string"
#: Header lines of text and page files, and of PDF pages (fixed values).
TEXT_HEADER = r"^第[一二三四五六七八九十百零〇\d]+[章节条]|^[一二三四五六七八九十]+、|^（[一二三四五六七八九十]+）|^\d+\.\d*\s*\S"
PDF_HEADER = r"^第[一二三四五六七八九十百零〇\d]+[章节条部分]|^[一二三四五六七八九十]+、|^（[一二三四五六七八九十]+）|^\d+\.\d*\s*\S"
#: Markup that is not text, in the order in which it is taken out.
STRIP = ((r"(?s)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>", " "), (r"(?s)<!--.*?-->", " "), (r"</?(p|h1|h2|h3|div|li|article|br)[^>]*>", "\n"), (r"<[^>]*>", ""))


def load_questions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """JSON arrays of questions by domain; files that aren't there are skipped; ``domain`` and ``doc_ids`` are filled in."""
    out = spark.createDataFrame([], QUESTION)
    for domain, path in paths.items():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            rows = spark.read.schema(QUESTION).json(path, multiLine=True)
            out = out.unionByName(rows.withColumn("domain", F.coalesce("domain", F.lit(domain))))
    return out.withColumn("doc_ids", F.coalesce("doc_ids", F.when(F.col("doc_id").isNotNull(), F.array("doc_id")), F.array().cast("array<string>"))).drop("doc_id")


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, stem, file_type, length), without reading contents."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), T.file_type(F.col("path")).alias("file_type"), "length")


def resolve_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Documents (doc_id, domain) to files (path, name, stem, ...). PDF before pdf; ids that begin with strict_v3_ take the first
    text file whose name begins with them, ids with _att a PDF attachment, csrc_ ids a page; null without a file."""
    regulatory = F.col("domain") == "regulatory"
    strict = regulatory & F.col("doc_id").startswith("strict_v3_")
    attached = regulatory & ~strict & F.col("doc_id").contains("_att")
    page = regulatory & ~strict & ~attached & F.col("doc_id").startswith("csrc_")
    asked = wanted.withColumn("__want", F.when(strict, "txt").when(attached, "pdf").when(page, "html").when(~regulatory, "pdf")).withColumn("__prefix", strict)
    asked = asked.withColumn("__prefix", F.coalesce("__prefix", F.lit(False)))
    held = files.select("path", "name", "stem", "file_type")
    # Joined by equal keys throughout: a name that an id may begin has each of its beginnings as a key.
    begins = F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.col("name").substr(F.lit(1), n))
    longer = held.where(F.col("name").startswith("strict_v3_")).select("path", "file_type", F.explode(begins).alias("__key"))
    named = held.select("path", "file_type", F.col("stem").alias("__key"))
    fits = (F.col("doc_id") == F.col("__key")) & (F.col("file_type") == F.col("__want"))
    found = asked.where("not __prefix").join(named, fits, "left").unionByName(asked.where("__prefix").join(longer, fits, "left"))
    upper = F.when(F.col("path").endswith(".PDF"), 0).otherwise(1)
    n = F.row_number().over(Window.partitionBy("domain", "doc_id").orderBy(upper, "path"))
    return found.withColumn("__n", n).where("__n = 1").select("doc_id", "domain", "path", F.coalesce("file_type", F.lit("unknown")).alias("file_type"))


def text_blocks(docs: DataFrame, header: str = TEXT_HEADER, shorter_than: int = 50) -> DataFrame:
    """Texts (doc_id, domain, text) cut at header lines; blank lines are left out."""
    lines = S.lines_of(docs, "doc_id", "text").where(F.trim("line") != "")
    out = S.header_sections(lines, "doc_id", T.is_header(F.trim("line"), header, shorter_than))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("section")) - 1
    return out.join(docs.select("doc_id", "domain"), "doc_id").select("doc_id", "domain", seq.cast("bigint").alias("seq"), F.lit(1).alias("page_num"), F.col("title").alias("section_title"), F.col("body").alias("text"))


def read_texts(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Text files (doc_id, domain, path) as (doc_id, domain, text). Folders are read, not lists of files: only the
    distinct folders reach the driver, and files that aren't asked for are dropped by their path."""
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    folders = [r["f"] for r in paths.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], "doc_id string, domain string, text string")
    asked = paths.withColumn("__p", plain(F.col("path"))).select("doc_id", "domain", "__p")
    held = spark.read.text(folders, wholetext=True).select(plain(F.col("_metadata.file_path")).alias("__p"), F.col("value").alias("text"))
    return asked.join(held, "__p").select("doc_id", "domain", "text")


def strip_markup(html: Column) -> Column:
    for pattern, put in STRIP:
        html = F.regexp_replace(html, pattern, put)
    return html


#: Where the content of a page may lie, in order of preference.
CONTENT = (r'(?s)<div[^>]*class="[^"]*\bdetail-news\b[^"]*"[^>]*>(.*?)</div>', r'(?s)<div[^>]*class="[^"]*\bcontent\b[^"]*"[^>]*>(.*?)</div>', r'(?s)<div[^>]*class="[^"]*\barticle\b[^"]*"[^>]*>(.*?)</div>', r'(?s)<div[^>]*id="content"[^>]*>(.*?)</div>', r"(?s)<article[^>]*>(.*?)</article>", r"(?s)<body[^>]*>(.*?)</body>")


def content_of(html: Column) -> Column:
    """The first content container of a page, or the whole page."""
    return F.coalesce(*(F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in CONTENT), html)


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, seq, line): lines of pages that hold text, markup taken out."""
    lines = pages.select(key, F.posexplode(F.split(strip_markup(F.col(html)), "\n", -1)).alias("i", "line")).withColumn("line", F.trim("line")).where("line != ''")
    return lines.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("i")) - 1).cast("bigint").alias("seq"), "line")


#: A decoder turns a file's bytes into pages: dicts with page_num, text, and perhaps tables (lists of rows of cells).
Decoder = Callable[[bytes], Iterable[dict]]


def decode_pdfs(files: DataFrame, decoders: list[Decoder], max_pages: int | None = None, with_tables: bool = False) -> DataFrame:
    """PDF files (doc_id, domain, path, content) as blocks, one per page with text; decoders are tried in order.

    With tables, ``[TABLE]`` and rows of cells joined by `` | `` follow the page's text. Decoding has no
    built-in form, so this stage runs Python on Arrow batches; rows of one file at a time.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pages: list[dict] = []
                for decode in decoders:
                    try:
                        pages = list(decode(bytes(row.content)))
                        break
                    except Exception:  # noqa: BLE001 - the next decoder is tried
                        continue
                out = []
                for page in pages[:max_pages]:
                    text = page["text"].strip()
                    if with_tables:
                        for cells in page.get("tables", ()):
                            text += "\n[TABLE]\n" + "\n".join(" | ".join(c or "" for c in r) for r in cells)
                    if text:
                        out.append((row.doc_id, row.domain, len(out), page["page_num"], text.split("\n", 1)[0], text))
                yield pd.DataFrame(out, columns=["doc_id", "domain", "seq", "page_num", "first", "text"])

    rows = files.select("doc_id", "domain", "content").mapInPandas(run, "doc_id string, domain string, seq bigint, page_num int, first string, text string")
    title = F.when(T.is_header(F.col("first"), PDF_HEADER, 80), F.col("first")).otherwise("")
    return rows.select("doc_id", "domain", "seq", "page_num", title.alias("section_title"), "text")


def page_lines(lines: DataFrame) -> DataFrame:
    """Decoded lines (doc_id, page_num, x0, y0, text, font_size) in reading order, with ``ord``."""
    order = Window.partitionBy("doc_id").orderBy("page_num", F.round("y0", 1), "x0", "text")
    return lines.withColumn("ord", (F.row_number().over(order) - 1).cast("bigint"))


def clear_cache(spark: SparkSession, folder: str, domain: str) -> bool:
    """Remove a domain's partition of a block cache; whether there was one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/domain={domain}")
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def to_parse(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Documents (doc_id, domain) whose blocks aren't in the cache yet."""
    return wanted.join(cached.select("doc_id", "domain").distinct(), ["doc_id", "domain"], "left_anti")


def load_index(spark: SparkSession, folder: str, manifest: DataFrame) -> dict[str, DataFrame]:
    """Tables sections, units and field_cards (JSON lines under ``folder/doc_id/``) of the documents in the
    manifest (doc_id); documents without sections or units are left out."""
    def read(name: str) -> DataFrame | None:
        try:
            return spark.read.json(f"{folder}/*/{name}.jsonl")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    tables = {n: read(n) for n in ("sections", "units", "field_cards")}
    known = manifest.select("doc_id")
    for n in ("sections", "units"):
        if tables[n] is not None:
            known = known.join(tables[n].select("doc_id").distinct(), "doc_id", "left_semi")
    return {n: t.join(known, "doc_id", "left_semi") for n, t in tables.items() if t is not None}


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """(qid, answer) from CSV with a header, or JSON: an object of answers, an object of objects, or a list.

    Keys may be qid or question_id, answer or final_answer. The summary row of an answer file is left out.
    """
    if path.lower().endswith(".csv"):
        rows = spark.read.csv(path, header=True)
        pick = lambda *names: F.coalesce(*(F.col(n) for n in names if n in rows.columns), F.lit(None))
        return rows.select(pick("qid", "question_id").alias("qid"), pick("answer", "final_answer").alias("answer")).where("qid != 'summary'")
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = raw.select(F.explode_outer(F.try_variant_get("v", "$", "array<map<string,string>>")).alias("m")).where("m is not null")
    keyed = raw.select(F.explode_outer(F.try_variant_get("v", "$", "map<string,variant>")).alias("qid", "a")).where("qid is not null")
    flat = F.coalesce(F.try_variant_get("a", "$.answer", "string"), F.try_variant_get("a", "$.final_answer", "string"), F.try_variant_get("a", "$", "string"))
    of_list = listed.select(F.coalesce(F.try_element_at("m", F.lit("qid")), F.try_element_at("m", F.lit("question_id"))).alias("qid"), F.coalesce(F.try_element_at("m", F.lit("answer")), F.try_element_at("m", F.lit("final_answer"))).alias("answer"))
    return of_list.unionByName(keyed.select("qid", flat.alias("answer")))


def json_lines(rows: list[dict], path: str) -> None:
    """Small tables as JSON lines, for fixtures and configurations."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
