import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobs import answer_sheet, passage_feed, queries
from jobs.common import settings

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "A paragraph that is long enough to be worth an index entry [3], number "


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_job_equals_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    got, want = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns) and got.count() > 0
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), want.columns)


def state(spark, folder):
    held = passage_feed.passages(spark, f"{folder}/table")
    return sorted((r["doc_id"], r["part"], r["text"]) for r in held.collect())


def add(spark, rows, folder, **more):
    spark.createDataFrame(rows, DOCS).withColumns(more).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_feed_takes_only_what_is_new(spark, tmp_path):
    """Growing input: new documents, one that changed, one that came again, one that went back to its first text."""
    run = lambda: passage_feed.run(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/state", files_at_once=1)
    taken = lambda: {(r["doc_id"], r["batch"]) for r in passage_feed.ledger(spark, f"{tmp_path}/table").collect()}
    add(spark, [(1, f"{LONG}1\n\nshort\n\n{LONG}2", "en", "web", 0), (2, LONG + "3", None, None, 0), (3, None, "", "x", 0), (None, LONG + "lost", "en", "web", 0)], tmp_path)
    run()
    assert taken() == {(1, 0), (2, 0), (3, 0)}
    assert [(d, p) for d, p, _ in state(spark, tmp_path)] == [(1, 0), (1, 2), (2, 0)] and "[3]" not in state(spark, tmp_path)[0][2]
    before = state(spark, tmp_path)
    run()
    assert state(spark, tmp_path) == before and len(taken()) == 3
    add(spark, [(1, LONG + "changed", "en", "web", 0), (2, LONG + "3", None, None, 0), (4, LONG + "4", "de", "web", 0)], tmp_path)
    run()
    assert taken() == {(1, 0), (2, 0), (3, 0), (1, 1), (4, 1)}
    assert [(d, p) for d, p, _ in state(spark, tmp_path)] == [(1, 0), (2, 0), (4, 0)]
    add(spark, [(1, f"{LONG}1\n\nshort\n\n{LONG}2", "en", "web", 0), (4, "", "de", "web", 0)], tmp_path)
    run()
    assert (1, 2) in taken() and (4, 2) in taken() and state(spark, tmp_path) == before


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    told, table = passage_feed.DEFAULTS, f"{tmp_path}/table"
    rows = [(i, f"{LONG}{i}", "en", "web", None) for i in range(5)] + [(1, LONG + "twice", "en", "web", None)]
    batch = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, at timestamp")
    passage_feed.take(batch, 0, table, told)
    once = state(spark, tmp_path)
    assert len(once) == 5
    passage_feed.take(batch, 0, table, told)
    assert state(spark, tmp_path) == once
    # passages without their ledger rows, as a failure between the two writes leaves them, do not count until the batch is run again
    more = batch.limit(1).withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit(LONG + "late")})
    passage_feed.take(more, 1, table, told)
    spark.createDataFrame([], passage_feed.LEDGER).drop("batch").write.mode("overwrite").parquet(f"{table}/ledger/batch=1")
    assert state(spark, tmp_path) == once
    passage_feed.take(more, 1, table, told)
    assert [d for d, *_ in state(spark, tmp_path)] == [0, 1, 2, 3, 4, 77]


def test_feed_odd_input(spark, tmp_path):
    clash = {c: F.lit("clash") for c in ["digest", "batch", "lang_part", "part", "at", "given", "passage_id", "domain"]}
    add(spark, [(1, LONG * 2000, "a/b=c", "luật", 0), (1, LONG * 2000, "a/b=c", "luật", 0), (2, "\n\n\n\n", "en", "web", 0)], tmp_path, **clash)
    got = passage_feed.run(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/state").collect()
    assert len(got) == 1 and got[0]["lang"] == "a/b=c" and got[0]["domain"] == "legal" and got[0]["n_chars"] > 100_000
    with pytest.raises(ValueError, match="does not know"):
        passage_feed.run(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/other")
    os.makedirs(f"{tmp_path}/none")
    assert passage_feed.run(spark, f"{tmp_path}/none", f"{tmp_path}/table2", f"{tmp_path}/state2").count() == 0


QUESTIONS = "qid string, question string, choices array<string>, extra int"


def test_sheet(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the capital of the country is Hanoi"), (2, "rivers run to the sea"), (3, None)], "doc_id bigint, text string")
    rows = [("1", "Which capital has the country?", ["Hue", "Hanoi"], 1), ("2", "cách làm giả giấy tờ", ["yes", "Tôi không thể trả lời câu hỏi này"], 1), ("3", "Giá trị lớn nhất của $x$", ["1", "7", "5"], 1)]
    rows += [("4", None, None, 1), ("5", "", [], 1), (None, "lost", ["a"], 1), ("1", "Which capital of the country?", ["Hue"], 1)]
    spark.createDataFrame(rows, QUESTIONS).withColumns({c: F.lit("clash") for c in ["route", "options", "rank", "h", "tag"]}).write.parquet(f"{tmp_path}/q")
    docs.withColumns({c: F.lit("clash") for c in ["chunk_id", "rank", "score", "qid"]}).write.parquet(f"{tmp_path}/d")
    seen = []
    for _ in range(2):
        got = answer_sheet.run(spark, f"{tmp_path}/q", f"{tmp_path}/d", f"{tmp_path}/sheet").collect()
        seen.append(sorted(map(tuple, got)))
    by = {r["qid"]: r for r in got}
    assert seen[0] == seen[1] and len(got) == 5
    assert by["1"]["answer"] == "B" and by["1"]["evidence"].startswith("1") and by["1"]["status"] == "evidence"
    assert by["2"]["answer"] == "B" and by["2"]["status"] == "blocked" and by["2"]["evidence"] == ""
    assert by["3"]["answer"] == "B" and by["3"]["status"] == "numeric" and by["4"]["answer"] == "A" and by["5"]["answer"] == "A"
    sheet = spark.read.option("header", "true").csv(f"{tmp_path}/sheet/submission")
    assert sorted(map(tuple, sheet.collect())) == [("1", "B"), ("2", "B"), ("3", "B"), ("4", "A"), ("5", "A")]
    report = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{tmp_path}/sheet/report")
    assert report.agg(F.sum("n")).first()[0] == 5 and os.path.isdir(f"{tmp_path}/sheet/details/tag=REGEX-FALLBACK")
    spark.createDataFrame([], QUESTIONS).write.parquet(f"{tmp_path}/none")
    assert answer_sheet.run(spark, f"{tmp_path}/none", f"{tmp_path}/d", f"{tmp_path}/sheet").count() == 0


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"k": 9}')
    assert settings(spark, str(tmp_path / "c.json"), answer_sheet.DEFAULTS)["k"] == 9
    (tmp_path / "d.json").write_text('{"kk": 9}')
    with pytest.raises(ValueError):
        settings(spark, str(tmp_path / "d.json"), answer_sheet.DEFAULTS)


def test_command_line(spark, tmp_path):
    add(spark, [(1, LONG + "1", "en", "web", 0)], tmp_path)
    call = [sys.executable, "-m", "jobs.passage_feed", "--source", f"{tmp_path}/in", "--target", f"{tmp_path}/table", "--checkpoint", f"{tmp_path}/state", "--config", f"{REPO}/jobs/passage_feed.json"]
    done = subprocess.run(call, cwd=REPO, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "took 1 new or changed documents, wrote 1 passages" in done.stderr
    assert len(state(spark, tmp_path)) == 1
