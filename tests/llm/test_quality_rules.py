import collections
import math
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import quality_rules as Q


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#|é\x0b\xa0", max_size=60))
def test_features(text):
    words = Q.words_of(text)
    f = Q.base_features(text, words)
    assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, Q.base_failed(f)) == Q.plain_features(text)


def test_held_out_labels(spark, sf):
    """Fitted on one half of the labels (by hash); of the other half good documents stay and bad ones go."""
    folder = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen = labels.where("xxhash64(doc_id, 99) % 2 = 0")
    model = Q.fit(docs, seen)
    rest = Q.judge(docs, model).join(labels, "doc_id").where("not base_failed and xxhash64(doc_id, 99) % 2 != 0")
    got = rest.selectExpr("avg(if(quality = 1, int(kept), null)) good", "avg(if(quality = 0, int(kept), null)) bad", "count_if(quality = 0) n").first()
    assert got["good"] > 0.99 and got["n"] > 100 and got["bad"] <= 0.02


def plain_grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    codes = [zlib.crc32(re.sub("[1-9]", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in w)).encode()) for w in words]
    return codes, list(zip(codes, codes[1:]))


def plain_bucket(gram):
    """The bucket of a 1-gram (a number) or a 2-gram (a pair), with plain integers modulo 2^64."""
    code = gram if isinstance(gram, int) else gram[0] * 0x9E3779B97F4A7C15 + gram[1] * 0xC2B2AE3D27D4EB4F
    return (code * 0xD6E8FEB86659FD93 % (1 << 64) >> 20) % Q.BUCKETS


def test_scores_and_verdicts_by_brute_force(spark, sf):
    """Both multinomials, the mean log ratio, the threshold and every verdict, counted the long way."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    kinds = {r["doc_id"]: (r["quality"] == 1 and not r["toxic"], r["quality"] == 0) for r in labels.collect()}
    held = {r["doc_id"]: r["h"] for r in labels.selectExpr("doc_id", "xxhash64(doc_id, 7) % 2 = 0 h").collect()}
    raw, target = collections.Counter(), collections.Counter()
    mark = zlib.crc32(b"\n")
    for i, t in texts.items():
        one, _ = plain_grams(t)
        both = [mark, *one, mark]  # documents are parted by a word of their own
        got = collections.Counter(map(plain_bucket, [*one, *zip(both, both[1:])]))
        raw += got
        if kinds.get(i, (False,))[0] and not held[i]:
            target += got
    model = Q.fit(docs, labels)
    n, m = sum(raw.values()), sum(target.values())
    some = sorted(raw)[:: max(1, len(raw) // 3000)]
    near = 0
    for b in some:
        near += abs(model.weights[b] - math.log((target[b] + 1) / (m * raw[b] / n + 1))) < 0.02
    # Marks stand between documents of a partition, not around each: a few counts differ by one.
    assert near >= 0.99 * len(some)
    got = {r["doc_id"]: r for r in Q.judge(docs, model).collect()}
    scores = {}
    for i, t in texts.items():
        one, two = plain_grams(t)
        scores[i] = sum(model.weights[plain_bucket(g)] for g in [*one, *two]) / max(1, len(one) + len(two))
        assert abs(got[i]["score"] - scores[i]) < 1e-9
        assert got[i]["kept"] == (not Q.plain_features(t)[-1] and got[i]["score"] >= model.threshold)
    good = sorted(scores[i] for i, (g, _) in kinds.items() if g and held[i] and i in texts and not Q.plain_features(texts[i])[-1])
    assert sum(x < model.threshold for x in good) <= (1 - Q.SPARE) * len(good)


def test_odd_inputs(spark, docs, none, rows):
    labels = spark.createDataFrame([(10, 1, 0), (11, 0, 0), (12, 1, 1), (13, 1, None), (None, 1, 0), (10, 1, 0), (14, None, None)], "doc_id bigint, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = Q.judge(docs, model).collect()
    assert len(got) == len(rows) and not any(r["kept"] and r["base_failed"] for r in got)
    kept = Q.filter_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    bare = Q.fit(docs, labels.limit(0))
    assert all(r["kept"] != r["base_failed"] for r in Q.judge(docs, bare).collect())
    assert Q.judge(none, Q.fit(none, labels)).count() == 0


def test_clashing_names_and_long_texts(spark):
    names = "`doc_id` bigint, `text` string, `id` int, `score` int, `kept` int, `a.b` string, `key` int, `TEXT` string"
    words = "alpha beta gamma delta epsilon zeta " * 50_000
    rows = [(1, words, 1, 1, 1, "x", 1, "other"), (1, words, 1, 1, 1, "x", 1, "other"), (2, " ".join(f"w{i}" for i in range(90)), 2, 2, 2, "y", 2, None), (3, None, 3, 3, 3, "z", 3, "q")]
    docs = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = [(r["doc_id"], r["n_words"], r["base_failed"]) for r in Q.judge(docs, model).collect()]
    assert sorted(got) == [(1, 300_000, True), (1, 300_000, True), (2, 90, False), (3, 0, True)]
    kept = Q.filter_documents(docs, model)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
