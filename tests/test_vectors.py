import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.functions import text as t
from vellumspark.operators import retrieval as rt
from vellumspark.operators import vectors
from vellumspark.providers import FallbackChat, HashedEmbedder, Retrying, ask


def points(spark, n=600, size=12, seed=3):
    rng = np.random.default_rng(seed)
    made = [(f"p{i:04d}", rng.normal(size=size).round(4).tolist(), i) for i in range(n)]
    return spark.createDataFrame(made, "id string, vector array<float>, payload int")


def test_best_keeps_ties_by_id():
    rng = np.random.default_rng(0)
    scores, ids = rng.integers(0, 5, size=(4, 300)).astype(float), np.array([f"d{i:03d}" for i in rng.permutation(300)], object)
    best = rt.Best(4, 7)
    for a in range(0, 300, 43):
        best.add(scores[:, a : a + 43], ids[a : a + 43], above=0.0)
    for q in range(4):
        want = sorted(((-s, i) for s, i in zip(scores[q], ids, strict=True) if s > 0))[:7]
        assert [(-s, i) for s, i in zip(*best.held[q], strict=True)] == want


def test_collection(spark, tmp_path):
    made = points(spark, 50)
    held = vectors.Collection(spark, f"{tmp_path}/c", buckets=4)
    assert not held.exists()
    held.create(made.union(spark.createDataFrame([("none", None, 0)], made.schema)))
    assert held.exists() and held.points().count() == 50
    changed = made.filter("payload < 10").withColumn("payload", F.lit(-1)).union(made.limit(1).withColumn("id", F.lit("new")))
    for _ in range(2):
        held.upsert(changed)
        assert held.points().count() == 51 and held.points().filter("payload = -1").count() == 10
    held.upsert(made.limit(0))
    assert [r["id"] for r in held.scroll("p0003", 2).collect()] == ["p0004", "p0005"] and held.scroll(None, 1).first()["id"] == "new"
    assert held.lookup(made.limit(3)).count() == 3
    held.drop()
    assert not held.exists()


@pytest.mark.parametrize("cells", [8, 64])
def test_recall_of_the_index(spark, tmp_path, cells):
    made = points(spark)
    held = vectors.Collection(spark, f"{tmp_path}/c")
    held.create(made)
    told = held.build_index(cells=cells, k=10, recall=0.95)
    asked = made.filter("payload % 20 = 0").select(F.col("id").alias("qid"), "vector")
    exact = {(r["qid"], r["chunk_id"]) for r in rt.dense_search(made, asked, 10, "id", "vector").collect()}
    found = held.search(asked, 10).collect()
    assert told["recall"] >= 0.95 and told["points"] == 600
    assert len({(r["qid"], r["chunk_id"]) for r in found} & exact) >= 0.95 * len(exact)
    assert {r["qid"]: r["chunk_id"] for r in found if r["rank"] == 1} == {f"p{i:04d}": f"p{i:04d}" for i in range(0, 600, 20)}
    assert held.search(asked.limit(0), 10).count() == 0


def test_search_sees_changes(spark, tmp_path):
    """New, moved and deleted points before and after a merge, against the exact search over the valid points."""
    made = points(spark, 300)
    held = vectors.Collection(spark, f"{tmp_path}/c", buckets=4)
    held.create(made)
    held.build_index(cells=16)
    asked = made.filter("payload % 15 = 0").select(F.col("id").alias("qid"), "vector")

    def agree(n):
        assert held.points().count() == n
        exact = sorted(map(tuple, rt.dense_search(held.points(), asked, 7, "id", "vector").collect()))
        assert sorted(map(tuple, held.search(asked, 7, probes=1000, refine=0).collect())) == exact
        near = {(r["qid"], r["chunk_id"]) for r in held.search(asked, 7).collect()}
        assert n < 7 or len(near & {(q, c) for q, c, *_ in exact}) >= 0.9 * len(exact)

    agree(300)
    moved = made.filter("payload % 3 = 0").withColumn("vector", F.transform("vector", lambda x: -x))
    for _ in range(2):
        held.upsert(moved.union(made.limit(1).withColumn("id", F.lit("new"))))
    agree(301)
    assert held.search(made.limit(1).select(F.col("id").alias("qid"), "vector"), 1).first()["chunk_id"] in ("new", "p0000")
    held.delete(made.filter("payload % 5 = 1").union(made.limit(1).withColumn("id", F.lit("absent"))))
    agree(241)
    held.upsert(made.filter("payload = 6"))  # deleted before, and back
    agree(242)
    held.compact()
    assert not vectors.exists(spark, f"{tmp_path}/c/changes")
    agree(242)
    held.delete(made)
    agree(1)
    held.compact()
    agree(1)
    held.build_index()
    agree(1)


def test_many_changes_are_merged_by_themselves(spark, tmp_path):
    held = vectors.Collection(spark, f"{tmp_path}/c", buckets=2, most_changes=10)
    held.create(points(spark, 50))
    held.upsert(points(spark, 8))
    assert vectors.exists(spark, f"{tmp_path}/c/changes")
    held.delete(points(spark, 8).filter("payload < 5"))
    assert not vectors.exists(spark, f"{tmp_path}/c/changes") and held.points().count() == 45


def test_what_a_failure_cut_off_is_finished(spark, tmp_path, monkeypatch):
    held = vectors.Collection(spark, f"{tmp_path}/c", buckets=4)
    held.create(points(spark, 60))
    held.build_index(cells=4)
    held.delete(points(spark, 60).filter("payload < 20"))
    finish = held._finish
    monkeypatch.setattr(held, "_finish", lambda: None)  # stops where all is written aside
    held.compact()
    held._bucketed(points(spark, 10)).limit(0)
    monkeypatch.setattr(held, "_finish", finish)
    asked = points(spark, 60).select(F.col("id").alias("qid"), "vector")
    assert {r["chunk_id"] for r in held.search(asked, 1, 100, 0).collect()} <= {f"p{i:04d}" for i in range(20, 60)}
    assert held.points().count() == 40 and not vectors.exists(spark, f"{tmp_path}/c/merged") and not vectors.exists(spark, f"{tmp_path}/c/changes")
    held._bucketed(points(spark, 5)).write.partitionBy("bucket").parquet(f"{tmp_path}/c/replacing")
    assert held.points().count() == 5 and not vectors.exists(spark, f"{tmp_path}/c/cells")


def test_a_query_reads_about_as_many_points_in_a_larger_collection(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_POINTS", 50)
    rng, shares, read = np.random.default_rng(3), [], []
    for n in (1000, 8000):
        centres = rng.normal(size=(n // 25, 16))
        x = (centres[np.arange(n) % len(centres)] + 0.3 * rng.normal(size=(n, 16))).round(4)
        held = vectors.Collection(spark, f"{tmp_path}/c{n}")
        held.create(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<float>"))
        told = held.build_index(k=5)
        assert told["recall"] >= 0.95
        sizes = {r["cell"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/c{n}/cells").groupBy("cell").count().collect()}
        cells, _, told = held._model()
        q = rt._unit(x[:100])
        read.append(np.mean([sum(sizes.get(int(c), 0) for c in near) for near in cells.nearest(q, told["probes"])]))
        shares.append(read[-1] / n)
    assert shares[1] < shares[0] / 3 and read[1] < 3 * read[0]


@pytest.mark.parametrize("kind", ["int", "long", "string", "date", "short"])
def test_ids_of_any_type(spark, kind, tmp_path):
    """Question and point ids keep their types in every search."""
    as_kind = lambda c: F.date_add(F.lit("2020-01-01"), F.col(c).cast("int")) if kind == "date" else F.col(c).cast(kind)
    made = points(spark, 40).select(as_kind("payload").alias("id"), "vector")
    asked = made.limit(3).withColumnRenamed("id", "qid")
    held = vectors.Collection(spark, f"{tmp_path}/c")
    held.create(made)
    held.build_index(cells=4)
    texts = spark.range(3).select(as_kind("id").alias("chunk_id"), F.concat(F.lit("word w"), F.col("id").cast("string")).alias("vector_text"))
    dense, live = rt.dense_search(made, asked, 2, "id", "vector"), held.search(asked, 2)
    sparse = rt.bm25_search(texts, texts.select(F.col("chunk_id").alias("qid"), F.col("vector_text").alias("question")), 1)
    for found in (dense, live, sparse):
        assert dict(found.dtypes)["qid"] == dict(found.dtypes)["chunk_id"] == {"long": "bigint", "short": "smallint"}.get(kind, kind)
        first = found.filter("rank = 1").collect()
        assert len(first) == 3 and all(r["qid"] == r["chunk_id"] for r in first)


def test_index_search_equals_search(spark, tmp_path):
    words = [f"w{i}" for i in range(30)]
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, size=rng.integers(0, 40)))) for i in range(200)] + [(900, None)], "chunk_id long, vector_text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words, size=5))) for i in range(40)] + [("none", "zebra"), ("empty", None)], "qid string, question string")
    one = sorted(rt.bm25_search(docs, asked, 6).collect())
    assert one and sorted(rt.bm25_search(docs, asked, 6, most_terms=20).collect()) == one
    rt.save_index(rt.build_bm25(docs), f"{tmp_path}/index")
    saved = rt.load_index(spark, f"{tmp_path}/index")
    assert sorted(rt.index_search(saved, asked, 6).collect()) == one
    meta = spark.read.parquet(f"{tmp_path}/index/metadata").first()
    assert (meta["n_docs"], meta["n_terms"], meta["method"]) == (201, 30, "lucene")


def test_stop_words_bring_no_document_in(spark, tmp_path):
    """Over texts full of stop words the candidates are few, and the result is still exact."""
    rng = np.random.default_rng(2)
    stop, rare = [f"the{i}" for i in range(6)], [f"r{i}" for i in range(500)]
    docs = spark.createDataFrame([(i, " ".join([*stop, *rng.choice(rare, size=8), *rng.choice(stop, size=rng.integers(0, 9))])) for i in range(3000)], "chunk_id long, vector_text string")
    asked = spark.createDataFrame([(i, " ".join([*rng.choice(stop, size=4), *rng.choice(rare, size=3)])) for i in range(25)], "qid int, question string")
    rt.save_index(rt.build_bm25(docs), f"{tmp_path}/index")
    saved = rt.load_index(spark, f"{tmp_path}/index")
    found, lookups = rt.candidates(saved, asked, 5)
    assert sorted(rt.index_search(saved, asked, 5).collect()) == sorted(rt.bm25_search(docs, asked, 5).collect())
    postings = 25 * 4 * 3000  # every question shares four stop words with every document
    assert found.count() + lookups.count() < postings / 20
    only_stop = spark.createDataFrame([(1, "the0 the1"), (2, "none")], "qid int, question string")
    assert sorted(rt.index_search(saved, only_stop, 5).collect()) == sorted(rt.bm25_search(docs, only_stop, 5).collect())


def test_search_never_shuffles_the_corpus(spark, tmp_path):
    """No exchange of texts: the only one is that of each task's best."""
    spark.range(100).select(F.col("id").alias("chunk_id"), F.concat(F.lit("a b w"), F.col("id").cast("string")).alias("vector_text")).repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    found = rt.bm25_search(docs, spark.createDataFrame([("q", "b w7")], "qid string, question string"), 1)
    assert found.first()["chunk_id"] == 7
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Join" not in plan and "Exchange" not in below.split("Initial Plan")[0] and "RoundRobin" not in plan
    flags = docs.select("chunk_id", *[c.alias(n) for n, c in t.content_flags(F.col("vector_text")).items()])
    assert "Exchange" not in flags._jdf.queryExecution().executedPlan().toString()
    index = rt.build_bm25(docs)["postings"]._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in index and "vector_text" not in index.split("HashAggregate")[1]


def test_only_small_tables_are_dealt_anew(spark):
    assert rt.spread(spark.range(100, numPartitions=2)).rdd.getNumPartitions() == max(2, spark.sparkContext.defaultParallelism)
    assert rt.spread(spark.range(100, numPartitions=9)).rdd.getNumPartitions() == 9


class Shy:
    def __init__(self):
        self.calls = 0

    def reply(self, system, user):
        return "" if "2" in user else f"first {user}"

    def embed(self, text):
        self.calls += 1
        if self.calls < 3 or text == "never":
            raise OSError
        return [1.0]


class Sure:
    def reply(self, system, user):
        return f"second {user}"


def test_fallback_and_retries(spark):
    rows = spark.createDataFrame([("s", str(i)) for i in range(4)], "s string, u string")
    for at_once in (1, 3):
        got = {r["u"]: r["x"] for r in ask(rows, FallbackChat(Shy(), Sure()), "s", "u", "x", at_once=at_once).collect()}
        assert got == {"0": "first 0", "1": "first 1", "2": "second 2", "3": "first 3"}
    waits = []
    assert Retrying(Shy(), 3, lambda a: waits.append(a) or 0.0).embed("x") == [1.0] and waits == [0, 1]
    assert Retrying(Shy(), 2, lambda a: 0.0).embed("x") is None and Retrying(HashedEmbedder(4)).embed("a b") is not None


class Chooser:
    def reply(self, system, user):
        assert "[0] " in user and "x" * 301 not in user
        return "1, 0, 1, 7"


def test_rerank(spark):
    hits = spark.createDataFrame([("q", f"c{i}", i + 1) for i in range(4)] + [("few", "c0", 1), ("few", "c1", 2)], "qid string, chunk_id string, rank int")
    chunks = spark.createDataFrame([(f"c{i}", "x" * 400) for i in range(4)], "chunk_id string, display_text string")
    questions = spark.createDataFrame([("q", "which?"), ("few", "what?")], "qid string, question string")
    got = {(r["qid"], r["rank"]): r["chunk_id"] for r in rt.rerank(hits, questions, chunks, Chooser(), k=3).collect()}
    assert got == {("q", 1): "c1", ("q", 2): "c0", ("q", 3): "c2", ("few", 1): "c0", ("few", 2): "c1"}


def test_segmented_tokens(spark):
    phrases = t.LongestMatch(["xin chào", "xin chào bạn", "học sinh"])
    assert phrases("xin chào bạn học sinh giỏi xin") == ["xin_chào_bạn", "học_sinh", "giỏi", "xin"] and phrases("") == []
    df = spark.createDataFrame([("Xin chào, học-sinh!",), (None,)], "x string")
    assert [r[0] for r in df.select(t.segmented(phrases)(F.col("x"))).collect()] == [["xin_chào", "học_sinh"], []]


def test_any_number_of_queries_is_searched_in_blocks(spark, tmp_path, monkeypatch):
    """Blocks of queries and candidates that are handed on early change nothing."""
    made = points(spark, 400)
    held = vectors.Collection(spark, f"{tmp_path}/c")
    held.create(made)
    held.build_index(cells=16)
    held.upsert(made.filter("payload % 9 = 0").withColumn("vector", F.transform("vector", lambda x: -x)))
    asked = made.select(F.col("id").alias("qid"), "vector").union(spark.createDataFrame([("none", None)], "qid string, vector array<float>"))
    exact = sorted(map(tuple, rt.dense_search(held.points(), asked, 5, "id", "vector").collect()))
    whole = sorted(map(tuple, held.search(asked, 5).collect()))
    monkeypatch.setattr(vectors, "MOST_HELD", 40)
    assert sorted(map(tuple, held.search(asked, 5, block=90).collect())) == whole
    assert sorted(map(tuple, held.search(asked, 5, probes=1000, refine=0, block=90).collect())) == exact


@pytest.mark.parametrize("copies", [1, 6, 60])
def test_nearest_points_of_many_queries(copies, monkeypatch):
    """Equal to sorting all pairs, with ties by id, in whatever batches the points come and however little is held."""
    rng = np.random.default_rng(4)
    x = rt._unit(np.repeat(rng.normal(size=(600 // copies, 8)), copies, axis=0)[rng.permutation(600)])
    q = rt._unit(np.concatenate([rng.normal(size=(28, 8)), x[:1], np.zeros((1, 8))]))
    ids = np.array([f"p{i:03d}" for i in rng.permutation(600)], object)
    scores = np.round(q @ x.T, 6)
    for k in (1, 4, 30):
        want = [(i, ids[j]) for i in range(30) for j in sorted(range(600), key=lambda j, i=i: (-scores[i, j], ids[j]))[:k]]
        for held in (500_000, 50):
            monkeypatch.setattr(vectors, "MOST_HELD", held)
            best = vectors.Nearest(q, k)
            for a in range(0, 600, 150):
                first = best.open(vectors.pa.array(ids[a : a + 150]))
                for part in np.array_split(np.arange(150), 4):
                    best.add(np.arange(30), x[a + part], first + part)
            got = [(r["qid"], r["chunk_id"]) for b in best.batches(vectors.pa.array(range(30)), vectors.pa.string()) for r in b.to_pylist()]
            assert got == want


def test_many_queries_hand_on_no_candidates(spark, tmp_path):
    """Where the candidates by code would be as many as the points, a task gives k rows a query, and all that the candidates hold is found."""
    made = points(spark, 800)
    held = vectors.Collection(spark, f"{tmp_path}/c")
    held.create(made)
    told = held.build_index(cells=16)
    held.upsert(spark.createDataFrame([("nan", [float("nan")] * 12, 0)], made.schema))  # counts for nothing
    held.compact()
    asked = made.filter("payload % 4 = 0").select(F.col("id").alias("qid"), "vector")
    many, few = held.search(asked, 5), held.search(asked.limit(3), 5)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert 3 * told["refine"] < 800 <= 200 * told["refine"]
    assert plan(many).count("MapInArrow") == 1 and "Join" not in plan(many) and plan(few).count("MapInArrow") == 2
    exact = {(r["qid"], r["chunk_id"]) for r in rt.dense_search(made, asked, 5, "id", "vector").collect()}
    got = {(r["qid"], r["chunk_id"]) for r in many.collect()}
    by_code = {(r["qid"], r["chunk_id"]) for r in held.search(asked, 5, refine=told["refine"]).collect()}
    assert len(got) == 1000 and by_code & exact <= got & exact and len(got & exact) >= 0.95 * len(exact)


def test_recall_of_queries_that_the_index_was_not_fitted_on(spark, tmp_path, monkeypatch):
    """Few of the points are fitted on; the copies of all others are found as well."""
    for name, most in (("MOST_SAMPLED", 800), ("MOST_TRIED", 79), ("CELL_POINTS", 50)):
        monkeypatch.setattr(vectors, name, most)
    x = np.random.default_rng(6).normal(size=(1500, 24)).round(4)
    made = spark.createDataFrame([(f"p{i:04d}", x[i % 1500].tolist(), i) for i in range(9000)], "id string, vector array<float>, payload int")
    held = vectors.Collection(spark, f"{tmp_path}/c")
    held.create(made)
    told = held.build_index(k=5)
    asked = made.filter("payload < 1500").select(F.col("id").alias("qid"), "vector")
    exact = {(r["qid"], r["chunk_id"]) for r in rt.dense_search(made, asked, 5, "id", "vector").collect()}
    found = {(r["qid"], r["chunk_id"]) for r in held.search(asked, 5).collect()}
    assert told["recall"] >= 0.95 and len(found & exact) >= 0.9 * len(exact)
