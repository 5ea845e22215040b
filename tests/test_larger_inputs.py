"""Steps that meet many queries with many rows: joined by equal keys or computed in blocks, and the same results."""

import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from gleanery.operators import retrieval
from gleanery.sources import files


def plan_of(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def all_pairs(df):
    return [x for x in ("NestedLoopJoin", "CartesianProduct") if x in plan_of(df)]


def test_dense_top_k_without_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0, 2.0]), (303, [1.0, None] + [0.0] * 6)] + [(304 + i, rows[0][1]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "id bigint, vec array<float>").repartition(5)
    asked = vectors.where("id % 50 = 0 or id = 302").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    got = retrieval.dense_top_k(asked, vectors, 7)
    assert not all_pairs(got)
    scores = asked.crossJoin(vectors).withColumn("score", F.round(retrieval.cosine(F.col("qvec"), F.col("vec")), 6)).where("score > 0")
    want = {}
    for r in sorted(scores.collect(), key=lambda r: (r["qid"], -r["score"], r["id"])):
        want.setdefault(r["qid"], []).append((r["id"], r["score"]))
    held = {}
    for r in sorted(got.collect(), key=lambda r: (r["qid"], r["rank"])):
        held.setdefault(r["qid"], []).append((r["id"], r["score"]))
    assert held == {q: x[:7] for q, x in want.items()} and len(held[0]) == 7
    assert retrieval.dense_top_k(asked.limit(0), vectors, 7).count() == 0


def test_fusion_cuts_labels_before_the_join(spark, tmp_path):
    # One label for all: joined by label first, a query would meet every vector.
    from gleanery.plans import queries_index as Q

    rows = [(i, [float(i % 7), 1.0], 0) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = Q.rrf_fusion(spark, str(tmp_path))
    assert not all_pairs(got) and "WindowGroupLimit [label" in plan_of(got)
    assert got.groupBy("qid").count().where("count = 8").count() == 12


def test_one_number_in_many_chunks_and_queries(spark):
    # 400 million pairs share the number.
    chunks = spark.range(20_000).select((F.col("id") % 20).alias("doc_id"), F.col("id").alias("chunk_id"), F.array(F.lit("7"), (F.col("id") % 3).cast("string")).alias("numbers"))
    asked = spark.range(20_000).select(F.col("id").alias("qid"), F.array(F.lit("7"), F.lit("1")).alias("numbers"), F.when(F.col("id") % 2 == 0, F.array(F.lit(5), F.lit(4), F.lit(5))).when(F.col("id") < 20, F.array().cast("array<int>")).otherwise(F.array(F.lit(99))).cast("array<bigint>").alias("doc_ids"))
    got = retrieval.number_hits(asked, chunks).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("number", "doc_id", "chunk_id"))).alias("x")).collect()
    held = {r["qid"]: [tuple(x) for x in r["x"]] for r in got}
    assert set(held) == {q for q in range(20_000) if q % 2 == 0 or q < 20}
    assert held[0] == held[19_998] == [("1", 4, 4), ("1", 4, 64), ("7", 4, 4), ("7", 4, 24)]
    assert held[1] == [("1", 0, 40), ("1", 0, 100), ("7", 0, 0), ("7", 0, 20)]


def test_paths_by_equal_keys(spark):
    wanted = spark.createDataFrame([("a", "research"), ("a", None), ("strict_v3_x", "regulatory"), ("strict_v3_none", "regulatory"), ("csrc_1", "regulatory"), ("n_att", "regulatory"), (None, "research")], "doc_id string, domain string")
    names = ["a.pdf", "a.PDF", "strict_v3_xy.txt", "strict_v3_x.txt", "strict_v3_x.pdf", "csrc_1.html", "csrc_1.pdf", "n_att.pdf"]
    kinds = {"pdf": "pdf", "txt": "txt", "html": "html"}
    held = spark.createDataFrame([(f"/d/{n}", n, n.rsplit(".", 1)[0], kinds[n.rsplit(".", 1)[1].lower()]) for n in names], "path string, name string, stem string, file_type string")
    got = files.resolve_paths(wanted, held)
    assert not all_pairs(got)
    assert {(r["doc_id"], r["domain"]): r["path"] for r in got.collect()} == {
        ("a", "research"): "/d/a.PDF", ("a", None): None, ("strict_v3_x", "regulatory"): "/d/strict_v3_x.txt", ("strict_v3_none", "regulatory"): None,
        ("csrc_1", "regulatory"): "/d/csrc_1.html", ("n_att", "regulatory"): "/d/n_att.pdf", (None, "research"): None,
    }


def test_quota_ranks_only_reserved_places(spark):
    rows = [(i % 2, i, f"{'License' if i % 3 == 0 else 'text'} {i // 4}", (i * 7) % 50) for i in range(400)]
    blocks = spark.createDataFrame(rows, "source int, id bigint, text string, score int")
    got = retrieval.quota(blocks, "source", F.col("text").contains("License"), 8)
    # Every window over whole groups is cut as it is sorted.
    windows = [x for x in plan_of(got).splitlines() if "WindowGroupLimit" in x]
    assert len(windows) >= 4
    want = []
    for s in (0, 1):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[3], r[1]))
        first = {r[1] for r in [r for r in own if "License" in r[2]][:4]}
        ranked = sorted(((0 if r[1] in first else 1 if "License" not in r[2] else 2), -r[3], r[1], r[2]) for r in own)
        seen, kept = set(), []
        for b, _, i, text in ranked:
            if text not in seen:
                seen.add(text)
                kept.append((s, i, b, len(kept) + 1))
        want += kept[:8]
    assert sorted((r["source"], r["id"], r["bucket"], r["place"]) for r in got.collect()) == sorted(want)


def test_places_without_a_window_over_all(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("doc_id")).repartition(7)
    got = sorted((r["doc_id"], r["rank"]) for r in retrieval._numbered(rows, "doc_id").collect())
    assert [d for d, _ in got] == sorted(r["doc_id"] for r in rows.collect()) and [k for _, k in got] == list(range(1, 3001))
