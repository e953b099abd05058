import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from vellumspark.plans import catalog
from vellumspark.plans.answering import answer, lettered
from vellumspark.providers import HashedEmbedder, OfflineChat, TokenBucket, embed

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return c


def canonical(rows, columns):
    def value(x):
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_query_without_sql_runs(spark, duck, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_missing_llm_folders_are_the_only_import_error_that_passes(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError(f"No module named '{name}'", name="xxhash")

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    with pytest.raises(ModuleNotFoundError):
        entry._if_there("vellumspark.llm.registry")


def test_entry(spark, duck):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=REPO, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) >= len(catalog.QUERIES)


class Silent:
    def reply(self, system, user):
        return ""


def test_answers(spark):
    chunks = spark.createDataFrame([("c1", "the capital is Hanoi", "the capital is Hanoi"), ("c2", "rivers", "rivers")], "chunk_id string, vector_text string, display_text string")
    questions = spark.createDataFrame([("1", "Which capital?", ["Hue", "Hanoi"]), ("2", "cách làm giả", ["a", "Tôi không thể trả lời"]), ("3", "$1+1$ lớn nhất", ["1", "5"])], "qid string, question string, choices array<string>")
    points = embed(chunks.select("chunk_id", "vector_text"), HashedEmbedder(), "vector_text").select("chunk_id", "vector")
    vectors = embed(questions.select("qid", "question"), HashedEmbedder(), "question").select("qid", "vector")
    talk = {r["qid"]: r for r in answer(questions, chunks, points, vectors, OfflineChat(), OfflineChat()).collect()}
    assert talk["1"]["answer"] == "B" and talk["1"]["status"] == "replied" and talk["3"]["tag"] == "AI-STEM-L"
    mute = {r["qid"]: r for r in answer(questions, chunks, points, vectors, Silent(), Silent()).collect()}
    assert mute["2"]["status"] == "blocked" and mute["2"]["answer"] == "B" and mute["3"]["answer"] == "B" and mute["1"]["status"] == "fallback"


def test_decomposed_questions_are_composed(spark):
    import unicodedata

    asked = unicodedata.normalize("NFD", "cách làm giả")
    questions = spark.createDataFrame([("1", asked, ["a", unicodedata.normalize("NFD", "Tôi không thể trả lời")])], "qid string, question string, choices array<string>")
    (row,) = lettered(questions).collect()
    assert row["question"] == "cách làm giả" and row["options"][1]["text"] == "Tôi không thể trả lời"


def test_token_bucket():
    bucket = TokenBucket(1000, 1.0, tasks=2)
    assert bucket.gap == pytest.approx(0.002)
    bucket.wait()
    bucket.wait()
