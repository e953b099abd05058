"""What grows with the input: each step reads its input as often as it has to, and gives the same rows."""

import re

import numpy as np
from pyspark.sql import functions as F

from vellumspark.operators import chunking
from vellumspark.operators import retrieval as rt
from vellumspark.plans import answering
from vellumspark.providers import HashedEmbedder, embed
from vellumspark.settings import Settings


def corpus(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, size=rng.integers(0, 30)))) for i in range(300)] + [(900, None)], "chunk_id long, vector_text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words, size=6))) for i in range(50)] + [("none", "zebra"), ("empty", None)], "qid string, question string")
    return docs, asked


def test_saving_reads_the_texts_once(spark, tmp_path):
    docs, _ = corpus(spark)
    read = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def words(texts):
        read.add(len(texts))
        return texts.map(lambda x: (x or "").split())

    rt.save_index(rt.build_bm25(docs, tokenizer=words), f"{tmp_path}/index")
    assert read.value == 301


def test_a_batch_takes_each_posting_once(spark, tmp_path):
    """Postings go to their documents, not to a join with every question's documents; blocks of questions change nothing."""
    docs, asked = corpus(spark)
    rt.save_index(rt.build_bm25(docs), f"{tmp_path}/index")
    saved = rt.load_index(spark, f"{tmp_path}/index")
    found = rt.index_search(saved, asked, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan
    one = sorted(rt.bm25_search(docs, asked, 4).collect())
    assert one and sorted(found.collect()) == one == sorted(rt.index_search(saved, asked, 4, most_terms=40).collect())


def test_documents_come_in_pieces(spark):
    """A document whose postings lie in several batches, and steps of a few partial scores."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    ids, at, weight = np.sort(rng.integers(0, 20, 200)), rng.integers(0, 3, 200).astype(np.int32), rng.random(200)
    first, query, shares = np.array([0, 2, 3, 5]), np.array([0, 1, 1, 0, 2]), np.array([1.0, 2.0, 0.5, 3.0, 1.5])
    whole = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at), pa.array(weight)], ["chunk_id", "at", "weight"])

    def run(size, held, at_once):
        batches = iter([whole.slice(i, size) for i in range(0, 200, size)])
        out = pa.Table.from_batches(list(rt._score_dealt(["a", "b", "c"], pa.string(), first, query, shares, 5, held, at_once)(batches)))
        return out.to_pylist()

    want = np.zeros((3, 20))
    for i, t, w in zip(ids, at, weight):
        for e in range(first[t], first[t + 1]):
            want[query[e], i] += shares[e] * w
    got = run(200, 1000, 10**6)
    for n, q in enumerate("abc"):
        best = sorted(((-round(x, 6), i) for i, x in enumerate(want[n])))[:5]
        assert [(r["chunk_id"], round(r["score"], 6)) for r in got if r["qid"] == q] == [(i, -s) for s, i in best]
    assert got == run(7, 10, 1) == run(1, 1, 10)


def test_rows_of_one_id_are_one_document_of_an_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a b c d"), (3, "e")], "chunk_id long, vector_text string").repartition(3)
    index = rt.build_bm25(docs)
    rt.save_index(index, f"{tmp_path}/index")
    saved = rt.load_index(spark, f"{tmp_path}/index")
    rows = lambda df: sorted(tuple(r) for r in df.select("term", "chunk_id", "dl", "tf").collect())
    assert ("a", 1, 2, 2) in rows(saved["postings"]) and rows(saved["postings"]) == rows(index["postings"])
    assert {r["term"]: (r["df"], r["cf"]) for r in saved["term_stats"].collect()} == {"a": (2, 3), "b": (2, 2), "c": (2, 2), "d": (1, 1), "e": (1, 1)}


class Counting(HashedEmbedder):
    """Counts its calls."""

    def __init__(self, calls):
        super().__init__()
        self.calls = calls

    def embed(self, text):
        self.calls.add(1)
        return super().embed(text)


def articles(spark, n=30):
    return spark.createDataFrame([(f"t{i}", f"u{i}", f"Words of text {i} that is long enough to stay, " * 40, ["a", "b"]) for i in range(n)], "title string, url string, text string, categories array<string>")


def test_points_are_embedded_once(spark):
    """Both uses of the dense hits in the fusion are of one search."""
    calls = spark.sparkContext.accumulator(0)
    chunks = answering.answered_from(chunking.chunk_articles(articles(spark), "sub"))
    assert chunks.columns == ["chunk_id", "vector_text", "display_text"]
    questions = spark.createDataFrame([("q", "words of text 3", False, True), ("r", "long enough", False, False)], "qid string, question string, is_unsafe boolean, is_stem boolean").select("qid", "question", F.struct("is_unsafe", "is_stem").alias("route"))
    points = embed(chunks, Counting(calls), "vector_text").select("chunk_id", "vector")
    vectors = embed(questions, HashedEmbedder(), "question").select("qid", "vector")
    got = answering.retrieve(questions, chunks, points, vectors, Settings())
    assert {r["qid"] for r in got.collect()} == {"q", "r"} and calls.value == chunks.count()


def test_only_new_chunks_are_embedded(spark):
    """The indexed points are read for their ids alone, and a point's payload does not pass through Python."""
    calls, old = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    chunks = chunking.chunk_articles(articles(spark), "sub")
    indexed = rt.vector_points(chunks.filter("chunk_index = 1"), Counting(old))
    points, dead = rt.index_new(chunks, indexed, Counting(calls))
    ids = {r["chunk_id"]: tuple(r["vector"]) for r in points.select("payload.chunk_id", "vector").collect()}
    texts = {r["chunk_id"]: r["vector_text"] for r in chunks.filter("chunk_index <> 1").collect()}
    assert ids == {c: tuple(HashedEmbedder().embed(x)) for c, x in texts.items()} and texts
    assert calls.value == len(texts) and old.value == 0


def test_only_texts_of_new_chunks_enter_the_embedder(spark):
    """Rows wait in the JVM for their vectors: Python gets one column, so that a worker holds a batch of texts, whatever a payload weighs."""
    chunks = spark.createDataFrame([(f"t_{i}", i, "t", "c", "u", f"text {i}", "long " * 100) for i in range(5)], "chunk_id string, chunk_index int, doc_title string, doc_category string, doc_url string, vector_text string, display_text string")
    points, _ = rt.index_new(chunks, rt.vector_points(chunks.filter("chunk_index = 1"), HashedEmbedder()), HashedEmbedder())
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert [re.sub(r"#\d+", "", x) for x in re.findall(r"EvalPython \[\w+\((.*?)\)#", plan)] == ["vector_text"] and not re.search("MapIn(Pandas|Arrow)", plan)
    assert sorted(r["payload"]["chunk_id"] for r in points.collect()) == ["t_0", "t_2", "t_3", "t_4"]


def test_held_places_change_no_vector():
    texts = ["one two two", "", "three one", "Zwei EINS zwei"]
    assert [HashedEmbedder(8, most_held=1).embed(x) for x in texts] == [HashedEmbedder(8, most_held=0).embed(x) for x in texts]
    held = HashedEmbedder(8, most_held=2)
    assert [held.embed(x) for x in texts * 2] == [HashedEmbedder(8).embed(x) for x in texts * 2] and len(held.held) == 2
