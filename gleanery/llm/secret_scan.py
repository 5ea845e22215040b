"""Secret scan: a trigram inverted index narrows the texts that each rule must verify.

From each rule's regular expression a Boolean query over trigrams is derived: a text
can match only if it holds the trigrams that the query asks for. Texts are indexed in
segments of about a megabyte: every trigram of every text is extracted once, and a segment's
index is its sorted (trigram, text) pairs, in which a trigram's posting list is found by
binary search. The cost of an index doesn't depend on the rules. A rule's candidates come
from intersecting and uniting postings; only they are verified with the regular expression.
A rule whose expression forces no trigram (``hex``) has the query "any text" and is run over
every text.

Trigrams are of UTF-8 bytes with ASCII letters in lower case, so one index serves rules with
and without case.

Defined results: a null text is empty and has no finding; every document gives one row;
texts are read whole, however long (a text longer than a segment is one of its own, indexed
in pieces of bounded size); empty tables give no rows; ties in start are ordered as the rules
are listed; rows with equal ids stay apart (each is scanned on its own); other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import batches_of, columns_of, place
from gleanery.session import ship_package

try:  # the parser of the standard library; its old name before Python 3.11
    from re import _constants as sre_c
    from re import _parser as sre_p
except ImportError:
    import sre_constants as sre_c
    import sre_parse as sre_p


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` characters must be in ``group`` for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII))

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


#: Kinds whose spans are always reported.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Formats of public services' keys, added to the base kinds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES

# ---------------------------------------------------------------- trigram queries
# A query is True (any text), bytes (one trigram), or ("and" | "or", frozenset of queries).
_MOST_STRINGS = 64


def _join(kind: str, parts) -> object:
    parts = set(parts)
    if kind == "and":
        parts.discard(True)
        if not parts:
            return True
    elif True in parts:
        return True
    flat = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _strings_query(strings: frozenset[str]) -> object:
    """Some text that holds one of ``strings``."""
    coded = [s.encode("utf-8", "surrogatepass") for s in strings]
    return _join("or", (_join("and", (s[i : i + 3] for i in range(len(s) - 2))) if len(s) > 2 else True for s in coded))


def _low(code: int) -> str:
    """The character with A-Z folded, as the index folds them; rules ignore the case of no others (re.ASCII)."""
    return chr(code + 32 if 65 <= code <= 90 else code)


def _walk(items) -> list[object]:
    """A sequence as parts in order: a frozenset of the strings that a part can be, or a query.

    A query breaks adjacency; strings on both sides of it are not joined.
    """
    parts: list[object] = []
    for op, arg in items:
        if op is sre_c.LITERAL:
            parts.append(frozenset([_low(arg)]))
        elif op is sre_c.IN:
            chars = set()
            for kind, value in arg:
                if kind is sre_c.LITERAL:
                    chars.add(_low(value))
                elif kind is sre_c.RANGE and value[1] - value[0] < 8:
                    chars |= {_low(c) for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            parts.append(frozenset(chars) if chars and len(chars) <= 8 else True)
        elif op is sre_c.SUBPATTERN:
            parts += _walk(arg[3])
        elif op is sre_c.BRANCH:
            parts.append(_branch([_walk(x) for x in arg[1]]))
        elif op in (sre_c.MAX_REPEAT, sre_c.MIN_REPEAT):
            low, high, inner = arg
            one = _whole(_walk(inner))
            if one is not None and high == 1:
                parts.append(one | {""} if low == 0 else one)
            elif low == 0:
                parts.append(True)
            else:
                parts += [_query(_walk(inner)), True]
        elif op in (sre_c.AT, sre_c.ASSERT_NOT):
            continue
        else:
            parts.append(True)
    return parts


def _whole(parts: list[object]) -> frozenset[str] | None:
    """The strings that the parts can be together, if they are few and known."""
    out = frozenset([""])
    for p in parts:
        if not isinstance(p, frozenset) or len(out) * len(p) > _MOST_STRINGS:
            return None
        out = frozenset(a + b for a in out for b in p)
    return out


def _branch(ways: list[list[object]]) -> object:
    whole = [_whole(w) for w in ways]
    if all(w is not None for w in whole) and sum(map(len, whole)) <= _MOST_STRINGS:
        return frozenset().union(*whole)
    return _join("or", map(_query, ways))


def _query(parts: list[object]) -> object:
    asked, held = [], frozenset([""])
    for p in parts:
        if isinstance(p, frozenset) and len(held) * len(p) <= _MOST_STRINGS:
            held = frozenset(a + b for a in held for b in p)
            continue
        asked.append(_strings_query(held))
        held = p if isinstance(p, frozenset) else frozenset([""])
        if not isinstance(p, frozenset):
            asked.append(p)
    return _join("and", [*asked, _strings_query(held)])


@functools.lru_cache(1024)
def trigram_query(pattern: str) -> object:
    """Boolean query over lower-case trigrams that every match of ``pattern`` satisfies; True if none is forced."""
    return _query(_walk(sre_p.parse(pattern)))


class Segment:
    """Postings of some texts: sorted, distinct trigram << 32 | text."""

    def __init__(self, texts: list[str]):
        self.size = len(texts)
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8)
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        owner = np.repeat(np.arange(len(coded)), sizes)
        parts = []
        for at in range(0, max(0, len(data) - 2), PIECE):
            end = min(len(data) - 2, at + PIECE)
            wide = data[at : end + 2].astype(np.uint32)
            gram = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
            text = owner[at:end]
            keys = gram.astype(np.int64) << 32 | text
            keys = keys[text == owner[at + 2 : end + 2]]  # no trigram spans two texts
            keys.sort()
            parts.append(keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys)
        self.keys = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

    def postings(self, trigram: bytes) -> np.ndarray:
        """The texts that hold the trigram, in order."""
        code = int.from_bytes(trigram, "big")
        a, b = np.searchsorted(self.keys, [code << 32, (code + 1) << 32])
        return self.keys[a:b] & 0xFFFFFFFF

    def candidates(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings(query)
        lists = sorted(map(self.candidates, query[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            if query[0] == "and" and not len(out):
                break
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


#: Bytes of text that a segment of several texts holds at most, and positions that are sorted at a time.
SEGMENT_BYTES = 1 << 20
PIECE = 1 << 20


def find_spans(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its findings (start, rule's place, end), in order."""
    asked = [trigram_query(r.pattern) for r in rules]
    segment = Segment(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, asked)):
        for i in segment.candidates(query).tolist():
            out[i] += [(a, k, b) for a, b in rule.spans(texts[i])]
    for found in out:
        found.sort()
    return out


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: ``key`` and ``findings`` array<struct<kind, start, end>> (code points, end exclusive)."""
    ship_package(docs.sparkSession)
    rows = columns_of(docs, key=key, text=text)
    kind = docs.schema.fields[place(docs, key)].dataType.simpleString()
    names = [r.kind for r in rules]

    def scan(batches):
        for batch in batches_of(batches, SEGMENT_BYTES):
            found = find_spans(batch.column(1).to_pylist(), rules)
            lists = [[{"kind": names[k], "start": a, "end": b} for a, k, b in x] for x in found]
            shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, shape)], ["key", "findings"])

    out = rows.mapInArrow(scan, f"key {kind}, findings array<struct<kind: string, start: bigint, end: bigint>>")
    return out.withColumnRenamed("key", key)


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of every document's findings: the columns of query ``op2_secret_scan``."""
    found = scan_secrets(docs)
    base = [r.kind for r in BASE_RULES]

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(joined(F.filter("findings", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base contract without an index, for tests."""
    found = sorted((a, k, b) for k, r in enumerate(BASE_RULES) for a, b in r.spans(text or ""))
    said = ",".join(f"{BASE_RULES[k].kind}:{a}:{b}" for a, k, b in found)
    n = [sum(k == j for _, k, _ in found) for j in range(3)]
    return (*n, hashlib.sha256(said.encode()).hexdigest())
