"""Scores beside BM25: boosts of structure, entities, domains and sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.vocab import Vocabulary


@dataclass(frozen=True)
class HybridWeights:
    field_card: float = 3.0
    financial_field: float = 2.0
    table_row: float = 1.8
    table: float = 1.0
    heading: float = 0.3
    depth: float = 0.15
    number: float = 0.4
    year: float = 0.8
    company: float = 1.0
    metric_alias: float = 2.2
    metric_exact: float = 4.0
    generic: float = 0.8
    stub: float = 1.0


def _per_named(query: Column, hay: Column, vocabulary: dict[str, list[str]], weight: float) -> Column:
    """``weight`` for every entry that the query names and the text holds."""
    out = F.lit(0.0)
    for name, aliases in vocabulary.items():
        words = [name, *aliases]
        out = out + F.when(T.contains_any(query, words) & T.contains_any(hay, words), weight).otherwise(0.0)
    return out


def _years(query: Column, hay: Column, weight: float) -> Column:
    return F.size(F.filter(F.array_distinct(T.find_all(query, T.YEAR)), lambda y: hay.contains(y))) * F.lit(weight)


def depth(path: Column) -> Column:
    return F.least(F.length(path) - F.length(F.translate(path, ">/", "")), F.lit(4))


def domain_boost(query: Column, hay: Column, name: Column, path: Column, kind: Column, v: Vocabulary) -> Column:
    """Metrics named exactly 8, held 3, years 1.2, companies 1, prior section 0.8, kinds 2.5, 1.5, -1."""
    exact = F.lit(0.0)
    for metric, aliases in v.metrics.items():
        exact = exact + F.when(T.contains_any(query, [metric, *aliases]) & (name == metric), 8.0).otherwise(0.0)
    kinds = F.when(kind == "field_card", 2.5).when(kind.isin("financial_field", "table_row"), 1.5).when(kind == "page_image_stub", -1.0).otherwise(0.0)
    prior = F.when(T.contains_any(path, v.section_priors), 0.8).otherwise(0.0)
    return F.coalesce(exact, F.lit(0.0)) + _per_named(query, hay, v.metrics, 3.0) + _years(query, hay, 1.2) + _per_named(query, hay, v.companies, 1.0) + prior + kinds


def word_bonus(query: Column, hay: Column, weight: float = 0.6) -> Column:
    """For every distinct number or run of Chinese characters of the query that the text holds."""
    words = F.array_distinct(T.find_all(query, WORDS))
    return F.size(F.filter(words, lambda w: hay.contains(w))) * F.lit(weight)


#: Distinct years, numbers and words of all queries that texts are looked through for at once.
MOST_WORDS = 2_000
WORDS = rf"[{T.CJK}]{{2,}}|20[0-9]{{2}}|[0-9]+(?:\.[0-9]+)?%?"


def boost_marks(queries: DataFrame, by: list[str], query: str, units: DataFrame, v: Vocabulary) -> tuple[DataFrame, DataFrame] | None:
    """:func:`domain_boost` and :func:`word_bonus` taken apart, so that no query meets a text for them: units (id, text,
    name, path, unit_type) as (id, base, marks), queries as (by..., mark, weight); a pair's boost is the unit's base and the
    weights of the marks that both have. None if queries have more words than units can be looked through for."""
    spark = queries.sparkSession
    asked, hay = F.col(query), F.col("text")
    said = queries.select(*by, F.explode(F.concat(*(F.transform(F.array_distinct(T.find_all(asked, p)), lambda w, x=x: F.struct(w.alias("word"), F.lit(x).alias("weight"))) for p, x in ((T.YEAR, 1.2), (WORDS, 0.6))))).alias("s"))
    words = sorted(r[0] for r in said.select("s.word").distinct().limit(MOST_WORDS + 1).collect())
    if len(words) > MOST_WORDS:
        return None
    named = [(3.0, [n, *a]) for n, a in v.metrics.items()] + [(1.0, [n, *a]) for n, a in v.companies.items()]
    exact, first = len(named), len(named) + len(v.metrics)
    entry = lambda mark, weight: F.struct(F.lit(mark).alias("mark"), F.lit(weight).alias("weight"))
    held = [F.when(T.contains_any(asked, names), entry(i, x)) for i, (x, names) in enumerate(named)]
    held += [F.when(T.contains_any(asked, [m, *a]), entry(exact + i, 8.0)) for i, (m, a) in enumerate(v.metrics.items())]
    weights = queries.select(*by, F.explode(F.filter(F.array(*held), lambda e: e.isNotNull())).alias("e")).select(*by, "e.mark", "e.weight") if held else None
    known = [F.when(T.contains_any(hay, names), i) for i, (_, names) in enumerate(named)] + [F.when(F.col("name") == m, exact + i) for i, m in enumerate(v.metrics)]
    marks = F.filter(F.array(*known), lambda i: i.isNotNull()) if known else F.array().cast("array<int>")
    if words:
        listed = spark.createDataFrame([(w, first + i) for i, w in enumerate(words)], "word string, mark int")
        of_words = said.select(*by, "s.word", "s.weight").join(F.broadcast(listed), "word").select(*by, "mark", "weight")
        weights = of_words if weights is None else weights.unionByName(of_words)
        places = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(first + i).alias("mark")) for i, w in enumerate(words)))
        inside = F.transform(F.filter(places, lambda w: hay.contains(w["word"])), lambda w: w["mark"])
        marks = F.concat(marks, F.when(hay.rlike(rf"[0-9{T.CJK}]"), inside).otherwise(F.array().cast("array<int>")))
    base = domain_boost(F.lit(""), hay, F.lit(None).cast("string"), F.col("path"), F.col("unit_type"), v)
    if weights is None:
        weights = queries.select(*by, F.lit(0).alias("mark"), F.lit(0.0).alias("weight")).limit(0)
    return units.select("id", base.alias("base"), marks.cast("array<int>").alias("marks")), weights


def hybrid_score(query: Column, hay: Column, name: Column, path: Column, kind: Column, domain: Column, v: Vocabulary, w: HybridWeights = HybridWeights()) -> Column:
    """Structure, entities and domain words, less a penalty for generic text; up to 3 numbers count."""
    structure = F.when(kind == "field_card", w.field_card).when(kind == "financial_field", w.financial_field).when(kind == "table_row", w.table_row).when(kind == "table", w.table).when(kind == "heading", w.heading).otherwise(0.0)
    entity = _per_named(query, hay, v.companies, w.company) + _years(query, hay, w.year)
    for metric, aliases in v.metrics.items():
        asked = T.contains_any(query, [metric, *aliases])
        entity = entity + F.when(asked & F.coalesce(name == metric, F.lit(False)), w.metric_exact).when(asked & T.contains_any(hay, [metric, *aliases]), w.metric_alias).otherwise(0.0)
    words = F.lit(0.0)
    for d, (weight, terms) in v.domain_keywords.items():
        words = words + F.when(domain == d, F.least(T.count_hits(hay, terms), F.lit(3)) * F.lit(weight)).otherwise(0.0)
    penalty = F.when(kind == "page_image_stub", w.stub).otherwise(0.0) + F.when(T.contains_any(hay, v.generic_terms), w.generic).otherwise(0.0)
    numbers = T.find_all(query, r"20[0-9]{2}|[0-9]+(?:\.[0-9]+)?%?")
    hits = F.least(F.size(F.filter(numbers, lambda n: hay.contains(n))), F.lit(3)) * F.lit(w.number)
    return F.round(structure + depth(path) * F.lit(w.depth) + entity + words - penalty + hits, 4)


def section_boost(score: Column, title: Column, page: Column, preferred: list[str], keywords: dict[str, list[str]], factor: float = 1.5) -> Column:
    """Scores of preferred sections times ``factor``; the cover is what stands on the first two pages."""
    words = [w for s in preferred for w in keywords.get(s, [])]
    liked = T.contains_any(title, words)
    if "cover" in preferred:
        liked = liked | (page <= 2)
    return F.when(liked, score * factor).otherwise(score)


def routing_boost(query: Column, section: Column, path: Column, domain: Column, v: Vocabulary) -> Column:
    """How well a section's text fits a question: metrics 3, years and companies 1, priors 1.5, depth, numbers 0.4."""
    prior = F.lit(0.0)
    for d, words in v.route_priors.items():
        prior = prior + F.when((domain == d) & T.contains_any(section, words), 1.5).otherwise(0.0)
    numbers = T.find_all(query, r"20[0-9]{2}|[0-9]+(?:\.[0-9]+)?%?")
    return _per_named(query, section, v.metrics, 3.0) + _years(query, section, 1.0) + _per_named(query, section, v.companies, 1.0) + prior + depth(path) * F.lit(0.15) + F.size(F.filter(numbers, lambda n: section.contains(n))) * F.lit(0.4)


def card_score(query: Column, card: Column, kind: Column, preferred: dict[str, list[str]]) -> Column:
    """Shared words, 0.35 per longer one, years 1, numbers 0.8, 2 for a card type that the query asks for; null
    without a shared word."""
    q, c = F.array_distinct(T.card_tokens(query)), F.array_distinct(T.card_tokens(card))
    shared = F.size(F.array_intersect(q, c))
    low = F.lower(card)
    longer = F.size(F.filter(q, lambda w: (F.length(w) >= 3) & low.contains(w))) * F.lit(0.35)
    years = F.size(F.filter(T.find_all(query, T.YEAR), lambda y: card.contains(y))) * F.lit(1.0)
    numbers = F.size(F.filter(T.find_all(query, r"[0-9]+(?:\.[0-9]+)?%?"), lambda n: card.contains(n))) * F.lit(0.8)
    liked = F.lit(0.0)
    for name, words in preferred.items():
        liked = liked + F.when((kind == name) & T.contains_any(query, words), 2.0).otherwise(0.0)
    return F.when(shared > 0, F.round(shared + longer + years + numbers + liked, 4))
