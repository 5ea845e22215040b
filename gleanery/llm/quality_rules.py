"""Quality rules: repetition rules plus a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed word 1- and 2-grams are counted: one over documents that
labels call good (the trusted target), one over all documents (the raw corpus). A
document's score is the mean, over its n-grams, of log p_target - log p_raw. A document
is kept when no base rule fails and its score reaches one threshold, the same for all.

Words are runs without ASCII white space; for n-grams they are lower-cased (A-Z), digits
count as one digit, and runs of ASCII punctuation stay as they are, so that junk marks
show. The threshold comes from labelled documents that the target was not counted on: it
lies so low that ``spare`` of the good ones stay.

Bounds: at most ``max_labelled`` labelled documents are used (those with the smallest hash
of the id; the rest add nothing to the model). Counts over the raw corpus cover every word
of every document; they are ``buckets`` numbers whatever the input.

Defined results: null text has no words (and fails the base rules); without any usable
label (or with one class only) the verdict is that of the base rules; texts are read whole,
however long; ties at the threshold are kept; repeated rows are judged alike, and a document
that labels name twice counts with its worst label; empty tables give no rows; other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import WHITE_CHARS, batches_of, columns_of, numbered, place, take_cache
from gleanery.session import ship_package

BUCKETS = 1 << 16
MAX_LABELLED = 20_000
#: Share of labelled good documents that the threshold must spare.
SPARE = 0.998
#: Counts by which the estimated ratio of every n-gram is drawn towards one.
EVEN = 1.0
#: Characters counted as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


class _Codes(dict):
    """A number for each word, remembered up to a bound on memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = code = zlib.crc32(word.lower().translate(_DIGITS))
        return code


_codes = _Codes()


def ngram_buckets(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the 1-grams, then of the 2-grams."""
    if not words:
        return np.zeros(0, np.int64)
    take_cache("quality", _codes.clear)
    one = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate((one * np.uint64(0xD6E8FEB86659FD93), two * np.uint64(0xD6E8FEB86659FD93)))
    return ((both >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


@dataclass(frozen=True)
class Features:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def base_features(text: str, words: list[bytes]) -> Features:
    lines: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(WHITE_CHARS):
            if line in lines:
                dup += 1
            else:
                lines.add(line)
    return Features(len(words), len(text) - sum(map(text.count, WHITE_CHARS)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words))


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text, the first time included."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + width - max(i, upto)
            upto = i + width
    return total


def base_failed(f: Features) -> bool:
    return f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words


@dataclass(frozen=True)
class Model:
    """weights[b] = log p_target(b) - log p_raw(b), smoothed; a document passes with a mean of ``threshold`` or more."""

    weights: np.ndarray
    threshold: float

    def score(self, words: list[bytes]) -> float:
        at = ngram_buckets(words, len(self.weights))
        return float(self.weights[at].mean()) if len(at) else 0.0


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Texts of a bounded sample of labelled documents: (id, good, fold, text)."""
    unique = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = unique.where("quality is not null").orderBy(F.xxhash64("id"), "id").limit(most)
    chosen = sample.select("id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"), (F.col("quality") == 0).alias("bad"))
    # At most ``most`` rows of 10 bytes: small enough to broadcast by construction.
    return columns_of(docs, id=key, text=text).join(F.broadcast(chosen), "id")


def _counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket over all rows' texts. One row per bucket and partition is shuffled, one per bucket comes back."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches_of(batches):
            words: list[bytes] = []
            for text in batch.column(0).to_pylist():
                own = words_of(text)
                words += own
                words.append(b"\n")  # 2-grams across documents fall on this word
                if len(words) > 200_000:
                    total += np.bincount(ngram_buckets(words, buckets), minlength=buckets)
                    words = []
            total += np.bincount(ngram_buckets(words, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    per = rows.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = per.toPandas()
    total = np.zeros(buckets, np.float64)
    total[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return total


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, most: int = MAX_LABELLED, spare: float = SPARE) -> Model:
    """Weights from all documents and the trusted ones; the threshold from labelled documents held out."""
    ship_package(docs.sparkSession)
    rows = columns_of(docs, text=text)
    raw = _counts(rows, buckets)
    labelled = _labelled(docs, labels, key, text, most).withColumn("held", F.xxhash64("id", F.lit(7)) % 2 == 0).persist()
    try:
        target = _counts(labelled.where("good and not held").select("text"), buckets)
        if not target.sum() or not raw.sum():
            return Model(np.zeros(buckets), 0.0)
        # log p_target / p_raw, with ``EVEN`` counts on either side that say "as in the raw corpus": an n-gram that
        # the target could hardly be expected to hold says little by its absence.
        weights = np.log((target + EVEN) / (target.sum() * raw / raw.sum() + EVEN))
        share = labelled.sparkSession.sparkContext.broadcast(weights)

        def score(batches):
            model = Model(share.value, 0.0)
            for batch in batches_of(batches):
                good, texts = batch.column(0), batch.column(1).to_pylist()
                words = list(map(words_of, texts))
                ok = [not base_failed(base_features(t, w)) for t, w in zip(texts, words)]
                yield pa.RecordBatch.from_arrays([good, pa.array(ok), pa.array([model.score(w) for w in words], pa.float64())], ["good", "ok", "score"])

        scored = labelled.where("held and (good or bad)").select("good", "text").mapInArrow(score, "good boolean, ok boolean, score double").where("ok").toPandas()
    finally:
        labelled.unpersist()
    return Model(weights, _threshold(scored["score"].to_numpy(float), scored["good"].to_numpy(bool), spare))


def _threshold(scores: np.ndarray, good: np.ndarray, spare: float) -> float:
    """Halfway down the widest gap that leaves ``spare`` of the good above it and parts the classes best."""
    if not good.any() or good.all():
        return float("-inf")
    fine, poor = np.sort(scores[good]), np.sort(scores[~good])
    floor = fine[int((1 - spare) * len(fine))]  # at most this share of the good lies below
    below = np.concatenate((poor, fine))
    below = below[below < floor]
    if not len(below):
        return float("-inf") if poor.min() > floor else float(floor)
    return float((below.max() + floor) / 2)


def judge(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base features, base_failed, score, kept."""
    ship_package(docs.sparkSession)
    kind = docs.schema.fields[place(docs, key)].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        model = shared.value
        for batch in batches_of(batches):
            rows = []
            for text_ in batch.column(1).to_pylist():
                words = words_of(text_)
                f = base_features(text_, words)
                bad, score = base_failed(f), model.score(words)
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, bad, score, not bad and score >= model.threshold))
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.bool_()), pa.array(columns[6], pa.float64()), pa.array(columns[7], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["key", *names, "base_failed", "score", "kept"])

    shape = f"key {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, score double, kept boolean"
    return columns_of(docs, key=key, text=text).mapInArrow(run, shape).withColumnRenamed("key", key)


def filter_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns, in one pass over the rows."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = place(docs, text)

    def run(batches):
        model = shared.value
        for batch in batches_of(batches):
            keep = []
            for text_ in batch.column(at).to_pylist():
                words = words_of(text_ or "")
                keep.append(not base_failed(base_features(text_ or "", words)) and model.score(words) >= model.threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    own = numbered(docs)
    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


def plain_features(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The base contract written the long way, for tests."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    marked = set()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            marked |= {i, i + 1, i + 2}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), sum(c in SYMBOLS for c in text), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n
