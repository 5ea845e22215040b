"""From raw model output to option letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that model outputs are read with, each table tried in order.
ANSWER_PATTERNS = (r"最终答案[是为：:]\s*([A-D]+)", r"答案[是为：:]\s*([A-D]+)", r"正确答案[是为：:]\s*([A-D]+)", r"(?m)选择?\s*([A-D]+)\s*$", r"综上[，,]?\s*(?:选择?|答案[是为]?)\s*([A-D]+)")
LETTER_PATTERNS = (r"答案[是为：:]\s*([A-D]+)", r"选择?\s*([A-D]+)", r"正确[的答案选项]*[是为：:]\s*([A-D]+)", r"^([A-D]+)\s*$", r"([A-D](?:[、,，\s]+[A-D])*)")
FIELD_PATTERNS = (r"准确选项[是为：:]\s*([A-D]+)", *ANSWER_PATTERNS)


def letters_in(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit("[A-D]"), F.lit(0))


def shape(letters: Column, kind: Column) -> Column:
    """Letters as an answer: mcq the first, tf the first of A and B, multi all in order."""
    two = F.filter(letters, lambda c: c.isin("A", "B"))
    return (
        F.when(F.size(letters) == 0, "A")
        .when(kind == "tf", F.coalesce(F.get(two, F.lit(0)), F.lit("A")))
        .when(kind == "multi", F.array_join(F.array_sort(F.array_distinct(letters)), ""))
        .otherwise(F.get(letters, F.lit(0)))
    )


def normalize_answer(raw: Column, kind: Column, patterns: tuple[str, ...] = ANSWER_PATTERNS, lines: int = 3, short_line: int = 15, short_text: int | None = 20, fold: bool = True) -> Column:
    """Short closing line, anchored pattern, short text, last five lines, else A.

    ``fold`` upper-cases before patterns are tried; ``short_text`` None skips that step.
    """
    text = F.coalesce(raw, F.lit(""))
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    parts = F.split(clean, "\n", -1)
    out = F.lit(None).cast("string")
    for back in range(1, lines + 1):
        line = F.trim(F.try_element_at(parts, F.lit(-back)))
        out = F.coalesce(out, F.when((F.size(letters_in(line)) > 0) & (F.length(line) < short_line), shape(letters_in(line), kind)))
    subject = F.upper(text) if fold else text
    for p in patterns:
        got = F.regexp_extract(subject, p, 1)
        out = F.coalesce(out, F.when(got != "", shape(F.split(got, ""), kind)))
    if short_text:
        out = F.coalesce(out, F.when((F.length(clean) < short_text) & (F.size(letters_in(clean)) > 0), shape(letters_in(clean), kind)))
    last = F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, F.greatest(F.size(parts) - 4, F.lit(1)), 5), "\n")).otherwise(text)
    found = letters_in(last)
    two = F.filter(found, lambda c: c.isin("A", "B"))
    end = (
        F.when(kind == "mcq", F.try_element_at(found, F.lit(-1)))
        .when(kind == "tf", F.coalesce(F.try_element_at(two, F.lit(-1)), F.lit("A")))
        .otherwise(F.array_join(F.array_sort(F.array_distinct(found)), ""))
    )
    out = F.coalesce(out, F.when(F.size(found) > 0, end))
    return F.when((text == "") | text.startswith("ERROR"), "A").otherwise(F.coalesce(out, F.lit("A")))


def field_answer(raw: Column, kind: Column) -> Column:
    """The variant of the field-pack path: last five lines under 20 characters, one more pattern."""
    return normalize_answer(raw, kind, FIELD_PATTERNS, lines=5, short_line=20, short_text=None, fold=False)


def extract_letters(raw: Column) -> Column:
    """All letters that the text answers with, as an array."""
    text = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", ""))
    none = F.array().cast("array<string>")
    out = F.when((F.length(text) < 20) & (F.size(letters_in(text)) > 0), letters_in(text))
    for p in LETTER_PATTERNS:
        got = letters_in(F.regexp_extract(text, p, 1))
        out = F.coalesce(out, F.when(F.size(got) > 0, got))
    return F.coalesce(out, letters_in(text), none)


def sanitize(answer: Column, kind: Column) -> Column:
    """Valid letters only, each once, in order; mcq and tf keep one."""
    found = F.array_sort(F.array_distinct(letters_in(F.coalesce(answer, F.lit("")))))
    two = F.filter(found, lambda c: c.isin("A", "B"))
    return (
        F.when(F.size(found) == 0, "A").when(kind == "mcq", F.get(found, F.lit(0)))
        .when(kind == "tf", F.coalesce(F.get(two, F.lit(0)), F.lit("A"))).otherwise(F.array_join(found, ""))
    )


def parse_selected(text: Column, most: Column) -> Column:
    """Numbers of chosen candidates: those in <<<n>>>, else all of one or two digits; in range, each once."""
    marked = F.regexp_extract_all(text, F.lit(r"<<<\s*([0-9]+)\s*>>>"), F.lit(1))
    loose = F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,2})\b"), F.lit(1))
    got = F.transform(F.when(F.size(marked) > 0, marked).otherwise(loose), lambda x: x.try_cast("bigint"))
    return F.array_distinct(F.filter(got, lambda n: n.between(1, most)))


def json_object(raw: Column) -> Column:
    """The JSON object in a model's output: the text itself, else its outermost braces, else a fenced block."""
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.nullif(braces, F.lit(""))), F.try_parse_json(F.nullif(fenced, F.lit(""))))


def verdict(raw: Column) -> tuple[Column, Column]:
    """(status, confidence) of a verifier's output; words are looked for where there is no JSON."""
    got = json_object(raw)
    status = F.lower(F.try_variant_get(got, "$.status", "string"))
    low = F.lower(raw)
    word = F.when(low.contains("contradicted"), "contradicted").when(low.contains("supported"), "supported").otherwise("mixed")
    status = F.when(status.isin("supported", "contradicted", "mixed"), status).when(status == "insufficient", "mixed").when(status.isNull(), word).otherwise("mixed")
    return status, F.coalesce(F.try_variant_get(got, "$.confidence", "double"), F.lit(0.5))
