import math

import pytest

from vellumspark.operators import retrieval as rt
from vellumspark.settings import Settings

DOCS = [("a", "cat dog dog"), ("b", "cat"), ("c", "bird, DOG!"), ("d", ""), ("e", None)]


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid string, chunk_id string, score double")


def ranked(df):
    return [(r["qid"], r["chunk_id"], r["rank"]) for r in df.orderBy("qid", "rank").collect()]


def test_bm25(spark):
    chunks = spark.createDataFrame(DOCS, "chunk_id string, vector_text string")
    asked = spark.createDataFrame([("q", "dog dog zebra"), ("r", "zebra"), ("s", "")], "qid string, question string")
    got = {r["chunk_id"]: r["score"] for r in rt.bm25_search(chunks, asked, 10).collect()}
    n, avg, idf = 5, 6 / 5, math.log(1 + (5 - 2 + 0.5) / 2.5)
    want = {c: 2 * idf * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avg)) for c, tf, dl in (("a", 2, 3), ("c", 1, 2))}
    assert got == pytest.approx(want, abs=1e-6) and n == 5
    index = rt.build_bm25(chunks)
    assert {r["term"]: (r["df"], r["cf"]) for r in index["term_stats"].collect()} == {"cat": (2, 2), "dog": (2, 3), "bird": (1, 1)}
    plan = rt.bm25_search(chunks, asked, 10)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan


def test_dense(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (4, [2.0, 2.0]), (5, None), (6, [0.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 1.0]), ("none", None)], "qid string, vector array<float>")
    got = rt.dense_search(points.repartition(3), asked, 3)
    assert [(r["chunk_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(2, 1.0), (4, 1.0), (1, pytest.approx(0.707107))]
    assert rt.dense_search(points, asked.limit(0), 3).count() == 0


def test_fusion(spark):
    sparse = hits(spark, [("q", "s", 9.0), ("q", "both", 5.0), ("q", "t", 5.0)])
    dense = hits(spark, [("q", "both", 0.9), ("q", "neg", -0.1)])
    score = lambda df: {r["chunk_id"]: r["score"] for r in df.collect()}
    pure = score(rt.fuse_ranks(sparse, dense, 10))
    assert pure == pytest.approx({"s": 0.5 / 60, "both": 0.5 / 60 + 0.5 / 61, "t": 0.5 / 62, "neg": 0.5 / 61}, abs=1e-8)
    compat = score(rt.fuse_ranks(sparse, dense, 10, compat=True))
    assert compat["neg"] == pytest.approx(0.5 / 63, abs=1e-8) and compat["s"] == pytest.approx(0.5 / 60 + 0.5 / 61, abs=1e-8)
    assert score(rt.fuse_ranks(sparse, dense, 10, absent=9999))["neg"] == pytest.approx(0.5 / 61 + 0.5 / 10059, abs=1e-8)
    assert score(rt.fuse_max_norm(sparse, dense, 10))["both"] == pytest.approx(0.5 + 0.5 * 5 / 9, abs=1e-6)
    assert "t" not in score(rt.fuse_max_norm(sparse, dense, 10, least=1.0, share=0.0))
    assert ranked(rt.fuse_ranks(sparse.orderBy("score"), dense, 2)) == [("q", "both", 1), ("q", "s", 2)]


def test_payload_and_reranking(spark):
    from pyspark.sql import functions as F

    chunks = spark.createDataFrame([("s", "text")], "chunk_id string, display_text string")
    assert rt.with_payload(hits(spark, [("q", "s", 1.0), ("q", "gone", 2.0)]), chunks, "chunk_id", ["display_text"]).count() == 1
    order = lambda reply, n, k: spark.range(1).select(rt.parse_ranking(F.lit(reply), F.lit(n), k).alias("x")).first()[0]
    assert order("2, 2, 99 then 0", 4, 3) == [2, 0, 1] and order(None, 3, 8) == [0, 1, 2]


def test_settings():
    assert Settings(alpha=0.3).stats()["alpha"] == 0.3
    with pytest.raises(ValueError):
        Settings(alpha=1.5)


def test_all_queries_have_a_dense_leg(spark, tmp_path):
    from vellumspark.plans.catalog import QUERIES

    spark.createDataFrame([(i, [float(i % 7 - 3), 1.0, float(i % 11)], i % 3) for i in range(300)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"nothing shared {i}") for i in range(5, 260)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "some words") for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda name: {r["qid"] for r in QUERIES[name](spark, str(tmp_path)).select("qid").distinct().collect()}
    for name in ("dense_topk", "dense_payload"):
        assert ids(name) == set(range(0, 300, 20))
    for name in ("hybrid_rrf", "hybrid_rrf_compat", "hybrid_rrf_9999", "hybrid_max_norm", "hybrid_threshold", "payload_complete"):
        assert ids(f"{name}") == set(range(5, 260))


def test_dense_in_blocks(spark):
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    asked = points.selectExpr("vec_id AS qid", "embedding AS vector")
    assert sorted(rt.dense_search_blocks(points, asked, 3, block=7).collect()) == sorted(rt.dense_search(points, asked, 3).collect())
