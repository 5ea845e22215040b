"""Text functions as Columns: normalising, hashing, tokens, numbers, headings, rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"
#: Patterns of words, numbers and runs of Chinese characters, of years, values, numbers and headings.
TOKEN_PATTERN = rf"[a-zA-Z]+[0-9]*|[0-9]+(?:\.[0-9]+)?%?|[{CJK}]{{2,}}"
CARD_TOKEN_PATTERN = rf"[{CJK}]{{2,}}|[A-Za-z]+|20[0-9]{{2}}|[0-9]+(?:\.[0-9]+)?%?"
YEAR = r"20[0-9]{2}"
VALUE = r"[-+]?[0-9][0-9,，]*(?:\.[0-9]+)?%?|[-+]?[0-9]+(?:\.[0-9]+)?\s*(?:亿元|万元|千元|元|港元|美元|万平方米|平方米|万m²|m²|GWh|MWh|TWh|%)"
CHUNK_NUMBERS = (r"[0-9]+\.?[0-9]*%", r"[0-9]+\.?[0-9]*[万亿]?元", r"[0-9]+\.?[0-9]*[万亿]", r"[0-9]{4}年", r"[0-9]+个?[工作]*日", r"[0-9]+个月", r"[0-9]+\.?[0-9]*")
QUERY_NUMBERS = (r"[0-9]+\.?[0-9]*%", r"[0-9]+\.?[0-9]*[万亿]?元", r"[0-9]{4}年", r"[0-9]+个?[工作]*日", r"[0-9]+\.?[0-9]*")
_NUMERALS = "一二三四五六七八九十百零〇壹贰叁肆伍陆柒捌玖拾"
_FRONT_MATTER = ["董事长致辞", "行长致辞", "致股东", "致股东的信", "年报速览", "重要提示", "释义", "目录", "财务报告", "审计报告"]
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def count_hits(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def normalize_text(text: Column) -> Column:
    """Odd spaces to spaces, byte order marks gone, full-width comma to comma, blanks collapsed, trimmed."""
    out = F.translate(F.coalesce(text, F.lit("")), "　 ﾠ，﻿", "   ,")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, rf"^{_SPACE}+|{_SPACE}+$", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(normalize_text(text), f"{_SPACE}+", "")


def stable_hash(text: Column, n: int = 10) -> Column:
    return F.substring(F.md5(text), 1, n)


def plain_number(text: Column) -> Column:
    return F.regexp_replace(normalize_text(text), "[,，]", "")


def is_noise_line(text: Column, keep: Iterable[str] = ("目录", "目次", "中国建筑股份有限公司", "2025年年度报告", "年度报告")) -> Column:
    t, tc = normalize_text(text), compact(text)
    return (
        F.when(t == "", True).when(tc.rlike(r"^[0-9]{1,4}$"), True).when(tc.isin(list(keep)), False)
        .when((F.length(tc) <= 2) & ~tc.rlike("[一二三四五六七八九十章节]"), True).otherwise(False)
    )


def heading_level(text: Column, font_size: Column | None = None) -> Column:
    """1 to 4, or null. Levels come from numbering; large short lines without numbers are level 2."""
    t, tc = normalize_text(text), compact(text)
    size = F.lit(0.0) if font_size is None else font_size
    return (
        F.when((t == "") | (F.length(tc) > 90), None)
        .when(tc.rlike(rf"^第[{_NUMERALS}0-9]+[章节].+"), 1)
        .when(tc.isin(_FRONT_MATTER), 1)
        .when(tc.rlike(rf"^[{_NUMERALS}]+[、.．].+"), 2)
        .when(tc.rlike(rf"^[（(][{_NUMERALS}]+[）)].+"), 3)
        .when(tc.rlike(r"^[0-9]+(?:\.[0-9]+)+[、.．].+"), 3)
        .when(t.rlike(r"^[0-9]+[、.．]\s*[^0-9].+") & (F.length(tc) <= 55), 4)
        .when((size >= 15) & (F.length(tc) <= 35) & ~tc.rlike(VALUE), 2)
    )


def is_header(text: Column, pattern: str, most: int) -> Column:
    """A line that opens a block: matches ``pattern`` and is shorter than ``most``."""
    return text.rlike(pattern) & (F.length(text) < most)


def _runs(chars: Column, n: int) -> Column:
    size = F.length(chars)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(chars, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def simple_tokens(text: Column) -> Column:
    """Words and numbers, then 2- and 3-grams over the Chinese characters.

    Of the normalising steps only the one that joins words matters here: byte order marks go.
    """
    t = F.lower(F.translate(F.coalesce(text, F.lit("")), "﻿", ""))
    grams = let(F.regexp_replace(t, rf"[^{CJK}]+", ""), lambda han: F.concat(_runs(han, 2), _runs(han, 3)))
    return F.concat(find_all(t, TOKEN_PATTERN), F.when(t.rlike(f"[{CJK}]"), grams).otherwise(F.array().cast("array<string>")))


def card_tokens(text: Column) -> Column:
    return F.transform(find_all(F.coalesce(text, F.lit("")), CARD_TOKEN_PATTERN), F.lower)


def numbers(text: Column, patterns: Iterable[str] = CHUNK_NUMBERS) -> Column:
    """Distinct numbers with their units, in text order of the alphabet (a total order)."""
    return F.array_sort(F.array_distinct(F.concat(*(find_all(text, p) for p in patterns))))


def canonical_metric(text: Column, metrics: dict[str, list[str]]) -> Column:
    """The first metric (in the vocabulary's order) one of whose aliases is in the text."""
    out = F.lit(None).cast("string")
    for name, aliases in reversed(list(metrics.items())):
        out = F.when(contains_any(text, aliases), F.lit(name)).otherwise(out)
    return out


def named(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """All entries whose name or alias is in the text, in the vocabulary's order."""
    return F.array_compact(F.array(*(F.when(contains_any(text, [name, *aliases]), F.lit(name)) for name, aliases in vocabulary.items())))


def expand_aliases(text: Column, metrics: dict[str, list[str]]) -> Column:
    """Names and aliases of every metric that the text mentions, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(none, *(F.when(contains_any(text, [m, *a]), F.array(*map(F.lit, [m, *a]))).otherwise(none) for m, a in metrics.items())))


def proxy_terms(text: Column, domain: Column, terms: dict[str, list[str]], stop: list[str], most: int = 30) -> Column:
    """Years, quantities, Latin words, domain terms and Chinese spans (or their 4- and 3-grams); each once, the first ``most``."""
    raw = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")

    def own_terms(hay: Column) -> Column:
        own = none
        for d, words in terms.items():
            own = F.when(domain == d, F.array_compact(F.array(*(F.when(hay.contains(w.replace(" ", "")), F.lit(w)) for w in words)))).otherwise(own)
        return own

    own = let(F.regexp_replace(raw, f"{_SPACE}+", ""), own_terms)
    spans = find_all(raw, rf"[{CJK}]{{2,}}")
    allowed = lambda x: ~x.isin(stop)
    grams = F.flatten(F.transform(spans, lambda s: F.when((F.length(s) <= 8) & allowed(s), F.array(s)).otherwise(F.filter(F.concat(_runs(s, 4), _runs(s, 3)), allowed))))
    units = r"[0-9]+(?:\.[0-9]+)?\s*%|[0-9]+(?:\.[0-9]+)?\s*(?:日|天|年|个月|亿元|万元|元|倍|家|只|项)"
    return F.slice(F.array_distinct(F.concat(find_all(raw, YEAR), find_all(raw, units), find_all(raw, r"[A-Za-z][A-Za-z0-9.-]+"), own, grams)), 1, most)


def proxy_coverage(terms: Column, evidence: Column) -> tuple[Column, Column]:
    """(share of terms in the evidence, whether every term with a digit is)."""
    both = F.struct(terms.alias("terms"), F.regexp_replace(F.coalesce(evidence, F.lit("")), f"{_SPACE}+", "").alias("hay"))

    def held(x: Column) -> Callable[[Column], Column]:
        return lambda t: x["hay"].contains(F.regexp_replace(t, f"{_SPACE}+", ""))

    share = let(both, lambda x: F.when(F.size(x["terms"]) > 0, F.size(F.filter(x["terms"], held(x))) / F.size(x["terms"])).otherwise(0.0))
    return share, let(both, lambda x: F.forall(F.filter(x["terms"], lambda t: t.rlike("[0-9]")), held(x)))


def safe_name(text: Column) -> Column:
    """A document id as a folder name."""
    out = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*]', "_"), "_{2,}", "_")
    return F.regexp_replace(F.substring(out, 1, 200), r"^[_. ]+|[_. ]+$", "")


def file_type(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(end == "pdf", "pdf").when(end == "txt", "txt").when(end.isin("html", "htm"), "html").otherwise("unknown")


def infer_domain(qid: Column, prefixes: dict[str, str]) -> Column:
    out = F.lit("unknown")
    for prefix, domain in reversed(list(prefixes.items())):
        out = F.when(qid.startswith(prefix), domain).otherwise(out)
    return out


def token_score(tokens: Column, budget: int) -> Column:
    return F.when(tokens <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (budget - tokens) / budget)))


def format_options(options: Column) -> Column:
    """A map of options as lines ``K. text``, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def evidence_id(doc: Column, *ids: Column, otherwise: Column) -> Column:
    """doc::first id there is, or doc::hash."""
    return F.concat_ws("::", doc, F.coalesce(*ids, F.substring(F.md5(otherwise), 1, 16)))


def render_fields(pairs: list[tuple[str, Column]], most: dict[str, int] | None = None) -> Column:
    """Lines ``label: value`` of the values that are there; values may be cut."""
    most = most or {}
    return F.concat_ws("\n", *(F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{k}: "), F.substring(v.cast("string"), 1, most.get(k, 1 << 30)))) for k, v in pairs))


def markdown_table(rows: Column) -> Column:
    """Rows of cells (the first is the header) as a Markdown table; line breaks in cells become spaces."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    shown = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, 2, 1 << 30)), "\n")


def column_headers(header_rows: Column, width: Column) -> Column:
    """Names of a table's columns from its header rows: distinct parts joined by ``/``, else col1, col2 ..."""
    def name(i):
        parts = F.array_distinct(F.filter(F.transform(header_rows, lambda r: F.trim(F.coalesce(F.get(r, i - 1), F.lit("")))), lambda p: p != ""))
        return F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise(F.concat(F.lit("col"), i.cast("string")))

    return F.transform(F.sequence(F.lit(1), width), name)
