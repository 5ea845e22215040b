"""Searches put together from ranking, boosts, fusion and lookups; and what surrounds them.

A unit table is (unit_id, doc_id, section_id, ord, unit_type, text), perhaps with ``name`` (a field
card's metric), ``path`` (its section's path) and ``domain``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.vocab import CHINESE, Vocabulary
from gleanery.operators import bm25, retrieval, scoring


def of_kinds(units: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None, columns: tuple[str, ...] = ("unit_type", "object_type")) -> DataFrame:
    """Units one of whose kind columns is in ``allow`` (if given) and none of whose is in ``deny``."""
    named = [F.coalesce(F.col(c), F.lit("")) for c in columns if c in units.columns]
    some = lambda words: F.arrays_overlap(F.array(*named), F.array(*map(F.lit, words)))
    out = units.where(some(allow)) if allow else units
    return out.where(~some(deny)) if deny else out


def simple_search(queries: DataFrame, units: DataFrame, k: int, vocabulary: Vocabulary = CHINESE, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """Best units for each query (qid, query): the query grown by its metrics' aliases, BM25 over all units, then the
    domain boost and 0.6 for every distinct word or number of the query that the unit holds; (qid, unit_id, score, rank)."""
    grown = queries.withColumn("grown", F.concat_ws(" ", "query", F.array_join(T.expand_aliases(F.col("query"), vocabulary.metrics), " ")))
    index = bm25.shared_index(units, "unit_id", "text")
    about = of_kinds(units, allow, deny)
    optional = lambda c: F.col(c) if c in units.columns else F.lit(None).cast("string")
    about = about.select(F.col("unit_id").alias("id"), "text", "unit_type", optional("name").alias("name"), F.coalesce(optional("path"), F.lit("")).alias("path"))
    terms = bm25.query_terms(grown, "qid", "grown")
    parts = scoring.boost_marks(grown, ["qid"], "grown", about, vocabulary)
    best = bm25.best(index, terms, "qid", k, extra=bm25.Extra(*parts)) if parts is not None else None
    if best is not None:
        return best.select("qid", F.col("id").alias("unit_id"), "score", "rank")
    scored = bm25.bm25_scores(index, terms, "qid").where("score > 0")
    joined = scored.join(about, "id").join(grown.select("qid", "grown"), "qid")
    boost = scoring.domain_boost(F.col("grown"), F.col("text"), F.col("name"), F.col("path"), F.col("unit_type"), vocabulary)
    total = joined.withColumn("score", F.round(F.col("score") + boost + scoring.word_bonus(F.col("grown"), F.col("text")), 4))
    return bm25.top_k(total, ["qid"], k, "id").select("qid", F.col("id").alias("unit_id"), "score", "rank")


def align_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_id, ...) with their vectors (doc_id, chunk_id, vec); chunks without one are left out."""
    return chunks.join(vectors.select("doc_id", "chunk_id", "vec"), ["doc_id", "chunk_id"])


def hybrid_search(lexical: DataFrame, dense: DataFrame, by: str = "id", k: int = 10, most: int = 8) -> DataFrame:
    """Lists of hits (qid, label, id, score), one lexical and one dense for the stem and each option, fused by reciprocal
    ranks: the first ``k`` of each list count; (qid, id, score, rank), the best ``most``."""
    lists = [bm25.top_k(x.select("qid", "label", by, "score"), ["qid", "label"], k, by).select("qid", by, "rank") for x in (lexical, dense)]
    fused = retrieval.reciprocal_ranks(lists[0].unionByName(lists[1]), ["qid", by]).withColumn("score", F.round("score", 6))
    return bm25.top_k(fused, ["qid"], most, by).select("qid", by, "score", "rank")


def per_document_fusion(hits: DataFrame, sections: DataFrame, preferred: list[str], keywords: dict[str, list[str]], k: int = 10, most: int = 12, factor: float = 1.5) -> DataFrame:
    """Hits (qid, doc_id, label, unit_id, score) of several queries inside each document: reciprocal ranks summed per
    document, units of preferred sections (unit_id, title, page) raised, the best ``most`` of each document."""
    ranked = bm25.top_k(hits, ["qid", "doc_id", "label"], k, "unit_id")
    fused = retrieval.reciprocal_ranks(ranked, ["qid", "doc_id", "unit_id"]).join(sections.select("unit_id", "title", "page"), "unit_id", "left")
    raised = scoring.section_boost(F.col("score"), F.coalesce("title", F.lit("")), F.coalesce("page", F.lit(1 << 30)), preferred, keywords, factor)
    return bm25.top_k(fused.withColumn("score", F.round(raised, 6)), ["qid", "doc_id"], most, "unit_id").select("qid", "doc_id", "unit_id", "score", "rank")


def options_and_numbers(hits: DataFrame, numbers: DataFrame, by: list[str], budget: int = 3000, text: str = "text", stem_k: int = 5, option_k: int = 2) -> DataFrame:
    """Hits of stem and options (qid, label, *by, score, text) and of numbers (qid, *by, score, text), scores added up per
    chunk; texts in that order until ``budget`` characters are used, the last one cut."""
    best = bm25.top_k(hits, ["qid", "label"], F.when(F.col("label") == "stem", stem_k).otherwise(option_k), *by)
    both = best.select("qid", *by, "score", text).unionByName(numbers.select("qid", *by, "score", text))
    added = both.groupBy("qid", *by).agg(F.round(F.sum("score"), 4).alias("score"), F.min(text).alias(text))
    ordered = [F.desc("score"), *by]
    used = F.sum(F.length(text)).over(Window.partitionBy("qid").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")
    rows = added.withColumn("before", used - F.length(text)).where(F.col("before") < budget)
    return rows.withColumn(text, F.expr(f"substring(`{text}`, 1, cast({budget} - before as int))")).drop("before")


def overlap_fallback(questions: DataFrame, blocks: DataFrame, docs: int = 3, k: int = 5) -> DataFrame:
    """For questions (qid, terms: distinct, doc_ids): the ``k`` blocks (doc_id, ord, terms: distinct) of their first
    ``docs`` documents that share most terms; if none shares any, the first ``k`` blocks; (qid, doc_id, ord, score, rank)."""
    asked = questions.select("qid", F.col("terms").alias("asked"), F.posexplode(F.slice("doc_ids", 1, docs)).alias("place", "doc_id"))
    pairs = asked.join(blocks, "doc_id").withColumn("score", F.size(F.array_intersect("asked", "terms")).cast("bigint"))
    best = F.max("score").over(Window.partitionBy("qid"))
    ranked = bm25.top_k(pairs.withColumn("best", best).where("score > 0 or best = 0"), ["qid"], k, "place", "ord")
    return ranked.select("qid", "doc_id", "ord", "score", "rank")


def with_ancestors(cards: DataFrame, units: DataFrame, sections: DataFrame) -> DataFrame:
    """Field cards (card_id, source_unit_id, ...) with their unit and its section; both may be missing."""
    of_unit = units.select(F.col("unit_id").alias("source_unit_id"), "section_id", F.col("text").alias("unit_text"))
    return cards.join(of_unit, "source_unit_id", "left").join(sections.select("section_id", "section_path"), "section_id", "left")


def pool_evidence(items: DataFrame) -> DataFrame:
    """Retrieved items (qid, evidence_id, label, covers: array, score, content) of all groups as one row per evidence:
    the best score, every label and option that it covers, and the content of the best item."""
    return items.groupBy("qid", "evidence_id").agg(
        F.max("score").alias("score"), F.array_sort(F.collect_set("label")).alias("labels"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("covers"), F.max_by("content", F.struct("score", "label")).alias("content"),
    )


def link_counter(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Items (qid, call, evidence_id) that counter searches (qid, call, tool, option) brought in, with the option that
    each of them speaks against."""
    asked = actions.where("tool = 'counter_search'").select("qid", "call", "option")
    return items.join(asked, ["qid", "call"]).select("qid", "evidence_id", "option").distinct()


def strong_cards(cards: DataFrame, strong_domains: list[str], least: float = 4.0) -> DataFrame:
    """Scored cards (domain, score, ...) of at least ``least``; all that have a score in strong domains."""
    return cards.where((F.col("score") >= least) | (F.col("domain").isin(strong_domains) & F.col("score").isNotNull()))


def valid_packs(packs: DataFrame, known: DataFrame, fallback: DataFrame) -> DataFrame:
    """Field packs (qid, doc_id, ...) of known documents (qid, doc_id); questions left without any take the fallback."""
    kept = packs.join(known.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")
    return kept.unionByName(fallback.join(kept, "qid", "left_anti"))


def longer_evidence(routed: DataFrame, whole: DataFrame, least: int = 6) -> DataFrame:
    """Evidence (qid, n_items, evidence) of the routed search; with fewer than ``least`` items the unrestricted one takes
    its place if its text is longer."""
    other = whole.select("qid", F.col("n_items").alias("__n"), F.col("evidence").alias("__e"))
    swap = (F.col("n_items") < least) & (F.length(F.coalesce("__e", F.lit(""))) > F.length("evidence"))
    return routed.join(other, "qid", "left").select("qid", F.when(swap, F.col("__n")).otherwise(F.col("n_items")).alias("n_items"), F.when(swap, F.col("__e")).otherwise(F.col("evidence")).alias("evidence"), F.coalesce(swap, F.lit(False)).alias("swapped"))


def asks_again(voted: DataFrame, low: float = 0.67) -> DataFrame:
    """Voted answers (qid, answer_format, answer, confidence) that a second call should look at: multiple choice with one
    letter, or little agreement between rounds."""
    return voted.where(((F.col("answer_format") == "multi") & (F.length("answer") <= 1)) | (F.col("confidence") < low))


def anchor_key(unit_id: Column, field_id: Column, source_unit_id: Column, item: Column) -> Column:
    """What an evidence item is merged by: its unit, field or source unit, else a hash of the item."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (unit_id, field_id, source_unit_id)), F.substring(F.md5(F.to_json(item)), 1, 16))


def haystack(fields: list[Column], siblings: Column, most: int = 3) -> Column:
    """An item's searchable text: its fields and the texts of the first ``most`` siblings."""
    return F.concat_ws(" ", *fields, F.concat_ws(" ", F.slice(siblings, 1, most)))


def render_chunks(rows: DataFrame, by: str, order: list[str], title: Column, text: str) -> DataFrame:
    """Chunks in order, each under its title, joined by rules."""
    body = F.concat(F.lit("["), title, F.lit("]\n"), F.col(text))
    listed = F.array_sort(F.collect_list(F.struct(*order, body.alias("__body"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["__body"]), "\n---\n").alias("evidence"))
