"""SQL of the corpus queries that SQL can express, written apart from the operators."""

from __future__ import annotations

OP3 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
w AS (SELECT doc_id, first_value(doc_id) OVER g AS keep_id, row_number() OVER g = 1 AS kept, plain FROM t WINDOW g AS (PARTITION BY plain ORDER BY n DESC, doc_id)),
c AS (SELECT plain, count(*) AS group_size FROM t GROUP BY plain)
SELECT doc_id, keep_id, group_size, kept, sha256(plain) AS text_sha256 FROM w JOIN c USING (plain)
"""

OP5 = r"""
WITH rows AS (
  SELECT conv_id, 0 AS origin, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
said AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS shown FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(concat('<|im_start|>', role, chr(10), shown, '<|im_end|>', chr(10)))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id, origin
"""

OP8 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS inside FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(inside, '</?(b|a|i|em|strong|span)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS plain FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(plain, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;?', '&', 'g') AS plain FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(plain, '[\s\x{a0}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""

OP10 = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s GROUP BY source),
-- Sources by the level at which they reach their cap: as if all before each one were capped and the rest shared what is left.
lev AS (SELECT *, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () - (sum(2 * source_size) OVER o - 2 * source_size) AS left_, sum(w) OVER () - (sum(w) OVER o - w) AS by_
  FROM src WINDOW o AS (ORDER BY source_size / w::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT left_, by_ FROM lev WHERE left_ * w / by_ <= cap ORDER BY cap / w::DOUBLE, source NULLS LAST LIMIT 1),
tgt AS (SELECT lev.source, lev.source_size, CASE WHEN cut.left_ * lev.w / cut.by_ <= lev.cap THEN cut.left_ * lev.w / cut.by_ ELSE lev.cap::DOUBLE END AS target,
  CAST(concat('0x', substr(sha256(concat('42:', CASE WHEN lev.source IS NULL THEN 'null' ELSE concat('source ', lev.source) END)), 11, 6)) AS BIGINT) AS off FROM lev, cut),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2 * 16777216, CAST(round(target / source_size * 16777216) AS BIGINT)) END AS each_ FROM tgt),
r AS (SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS k FROM s)
SELECT doc_id, size, source_size, target, ((off + k * each_) // 16777216 - (off + (k - 1) * each_) // 16777216) * size AS taken
FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""


def op2(rules: list[tuple[str, str, int, int]], base: int) -> str:
    """SQL of the secret scan for rules (kind, pattern, group, least), of which the first ``base`` are base kinds.

    Positions come from what lies between matches: splitting at a pattern and extracting it see the same matches.
    """
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, string_split_regex(text, $re${pattern}$re$) AS parts, "
        f"regexp_extract_all(text, $re${pattern}$re$) AS hits, regexp_extract_all(text, $re${pattern}$re$, {group}) AS inner_ FROM t"
        for k, (kind, pattern, group, least) in enumerate(rules)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in rules[:base])
    said = "string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, k, b)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
m AS (SELECT doc_id, k, kind, least, hits[u.i] AS hit, inner_[u.i] AS inner_,
    list_sum(list_transform(parts[1 : u.i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : u.i - 1], lambda x: length(x))), 0) AS a
  FROM f, unnest(range(1, len(hits) + 1)) AS u(i)),
s AS (SELECT doc_id, k, kind, CAST(a AS BIGINT) AS a, CAST(a + length(hit) AS BIGINT) AS b FROM m WHERE length(inner_) >= least),
g AS (SELECT doc_id, {counts}, {said} FILTER (k < {base}) AS said, {said} AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in rules[:base])}, sha256(coalesce(said, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON g.doc_id = t.doc_id
"""


def op1(model, forms: dict[str, list[list[str]]], word: str, confirm: float, unit: int) -> str:
    """SQL of the licence scan for a trained model and each family's templates as lists of grams.

    Paragraphs are put together from lines, grams are joined with tables of weights and of templates.
    """
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]"
    weights = ", ".join(f"({quoted(g)}, {list(w)!r}::BIGINT[])" for g, w in model.weights.items())
    templates = ", ".join(f"({quoted(f)}, {listed(t)})" for f, ts in forms.items() for t in ts)
    z = ", ".join(f"({b} + coalesce(sum(m.w[{k + 1}]), 0)) / ({unit} * {model.temperature}::DOUBLE)" for k, b in enumerate(model.bias))
    return rf"""
WITH m(gram, w) AS (VALUES {weights}),
tpl(family, t) AS (VALUES {templates}),
l AS (SELECT doc_id, u.i AS i, parts[u.i] AS line, u.i < len(parts) AND (regexp_matches(parts[u.i], $re$[.!?]["')\]]{{0,2}}[ \t\r]{{0,8}}$$re$) OR NOT regexp_matches(parts[u.i + 1], '[A-Za-z0-9]')) AS last
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)),
n AS (SELECT *, coalesce(sum(CAST(last AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM l),
d AS (SELECT doc_id, max(p) + 1 AS n_paragraphs FROM n GROUP BY doc_id),
ws AS (SELECT doc_id, p, regexp_extract_all(lower(string_agg(line, chr(10) ORDER BY i)), $re${word}$re$) AS ws FROM n GROUP BY doc_id, p),
g AS (SELECT doc_id, p, len(ws) AS n, list_distinct(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) AS grams FROM ws),
e AS (SELECT doc_id, p, unnest(grams) AS gram FROM g),
s AS (SELECT doc_id, p, [{z}] AS z FROM e JOIN m USING (gram) GROUP BY doc_id, p),
b AS (SELECT doc_id, p, {listed(model.families)}[list_position(z, list_max(z))] AS family, 1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS prob FROM s),
k AS (SELECT * FROM b WHERE family <> 'unknown' AND prob >= {model.least}),
f AS (SELECT k.*, (SELECT max(len(list_intersect(g.grams, t)) / greatest(1, least(g.n - 1, len(t)))::DOUBLE) FROM tpl WHERE tpl.family = k.family) AS sim FROM k JOIN g USING (doc_id, p)),
r AS (SELECT doc_id, count(*) AS n_found, count(*) FILTER (sim >= {confirm}) AS n_licensed, string_agg(DISTINCT family, ',' ORDER BY family) FILTER (sim >= {confirm}) AS families,
  string_agg(concat_ws(':', p, family, printf('%.4f', prob), printf('%.4f', sim)), ',' ORDER BY p) AS paragraphs FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(n_paragraphs AS BIGINT) AS n_paragraphs, coalesce(n_found, 0) AS n_found, coalesce(n_licensed, 0) AS n_licensed, coalesce(families, '') AS families, coalesce(paragraphs, '') AS paragraphs
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
