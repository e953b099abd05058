import datetime as dt
import random

from vellumspark.streaming import deadlines, jobs

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def plain(questions, replies, limit=10, tries=3):
    """The rule, a question at a time."""
    out = set()
    for qid, asked in questions:
        if asked is None:
            continue
        mine = sorted((n, when, said or "") for q, n, said, when in replies if q == qid and q is not None and when is not None and n is not None and 1 <= n <= tries and asked <= when <= asked + dt.timedelta(minutes=limit))
        answers = [said for _, _, said in mine if said.strip()]
        status = "replied" if answers else "gave_up" if any(n == tries for n, _, _ in mine) else "timed_out"
        out.add((qid, asked, answers[0] if answers else "A", status))
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("qid", "asked_at", "answer", "status").collect()), key=str)


def feed(spark, folder, questions, replies):
    spark.createDataFrame(questions, deadlines.QUESTIONS).coalesce(1).write.mode("append").parquet(f"{folder}/questions")
    spark.createDataFrame(replies, deadlines.REPLIES).coalesce(1).write.mode("append").parquet(f"{folder}/replies")


def run(spark, folder):
    questions = jobs.source(spark, f"{folder}/questions", "*.parquet", deadlines.QUESTIONS)
    replies = jobs.source(spark, f"{folder}/replies", "*.parquet", deadlines.REPLIES)
    deadlines.settle_stream(questions, replies, f"{folder}/table", f"{folder}/state").awaitTermination()
    return got(spark.read.parquet(f"{folder}/table"))


def test_each_case_has_its_status(spark):
    questions = [("in time", at(0)), ("to the second", at(0)), ("too late", at(0)), ("before", at(5)), ("blank", at(0)), ("second try", at(0)), ("fourth try", at(0)), (None, at(0)), ("no time", None), ("in time", at(60)), ("silent", at(0)), ("silent", at(0))]
    replies = [("in time", 1, "B", at(3)), ("to the second", 1, "C", at(10)), ("too late", 1, "C", at(11)), ("before", 1, "C", at(4)), ("blank", 1, "", at(1)), ("blank", 2, None, at(2)), ("blank", 3, " ", at(3))]
    replies += [("second try", 2, "D", at(4)), ("second try", 2, "C", at(4)), ("second try", 1, "", at(5)), ("fourth try", 4, "D", at(1)), (None, 1, "D", at(1)), ("nobody", 1, "D", at(1)), ("silent", None, "D", at(1)), ("silent", 1, "D", None)]
    found = got(deadlines.settle(spark.createDataFrame(questions, deadlines.QUESTIONS), spark.createDataFrame(replies, deadlines.REPLIES)))
    assert found == sorted(plain(questions, replies), key=str)
    assert {(q, s) for q, _, _, s in found} >= {("blank", "gave_up"), ("too late", "timed_out"), ("to the second", "replied"), (None, "timed_out")}


def test_no_rows_and_other_columns(spark):
    questions, replies = spark.createDataFrame([], deadlines.QUESTIONS), spark.createDataFrame([], deadlines.REPLIES)
    assert got(deadlines.settle(questions, replies)) == []
    named = spark.createDataFrame([("q", at(0), "x", "y")], "qid string, asked_at timestamp, answer string, status string")
    assert got(deadlines.settle(named, replies)) == [("q", at(0), "A", "timed_out")]


def test_a_stream_equals_the_batch_over_a_restart(spark, tmp_path):
    rng = random.Random(5)
    questions = [(f"q{i}", at(i)) for i in range(200)]
    replies = [(q, n, rng.choice(["B", "C", "", None]), asked + dt.timedelta(minutes=rng.randint(-2, 14))) for q, asked in questions for n in range(1, rng.randint(1, 5))]
    half = at(100)
    feed(spark, tmp_path, [q for q in questions if q[1] < half], [r for r in replies if r[3] < half])
    before = run(spark, tmp_path)
    assert 0 < len(before) < 100  # those whose time is not over are open
    feed(spark, tmp_path, [q for q in questions if q[1] >= half], [r for r in replies if r[3] >= half])
    assert set(before) < set(run(spark, tmp_path))
    for name, column in (("questions", "asked_at"), ("replies", "replied_at")):
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        deadlines.closing(rows, column, "2 hours").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    after = run(spark, tmp_path)
    assert after == sorted(plain(questions, replies), key=str) and {r[3] for r in after} == {"replied", "gave_up", "timed_out"}
    assert run(spark, tmp_path) == after


def test_a_reply_that_arrives_after_the_close_changes_nothing(spark, tmp_path):
    feed(spark, tmp_path, [("q", at(0)), ("", at(300))], [("", 1, None, at(300))])
    assert run(spark, tmp_path) == [("q", at(0), "A", "timed_out")]
    feed(spark, tmp_path, [("", at(600))], [("q", 1, "B", at(1)), ("", 1, None, at(600))])
    assert [r for r in run(spark, tmp_path) if r[0] == "q"] == [("q", at(0), "A", "timed_out")]


def test_an_endless_stream_stops_when_idle(spark, tmp_path):
    feed(spark, tmp_path, [("q", at(0))], [("q", 1, "B", at(1))])
    rows = jobs.source(spark, f"{tmp_path}/replies", "*.parquet", deadlines.REPLIES)
    query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/idle").trigger(processingTime="200 milliseconds").start()
    assert deadlines.stop_when_idle(query, 4) == 0 and not query.isActive
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
