"""Questions that wait for their replies: the first reply in time answers, a default stands in where none comes.

A stream-stream outer join on a time range and an aggregation by the question's
time, chained: the state store holds open questions and replies only, and the
watermark is the timer that closes them.  No Python state is needed, and the same
plan over batch frames gives the same rows.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUESTIONS = "qid string, asked_at timestamp"
REPLIES = "qid string, attempt int, answer string, replied_at timestamp"


def settle(questions: DataFrame, replies: DataFrame, limit: str = "10 minutes", late: str = "30 minutes", tries: int = 3, default: str = "A") -> DataFrame:
    """(qid, asked_at, answer, status) of every question, batch or stream.

    A reply counts if it comes from ``asked_at`` to ``limit`` after it, both
    included, and is one of the first ``tries`` attempts.  The first attempt that is
    not blank answers ('replied'; repeated ones: the earliest, then the smallest
    answer).  Else the answer is ``default``: 'gave_up' if the last attempt came
    back blank, 'timed_out' otherwise.  A stream gives a question out once its time
    is over and rows of that time can't come any more (``late``); what arrives later
    still changes nothing, in a rerun neither.  A null answer is a blank one; a
    reply to no question is forgotten; a question without a qid gets the default; rows
    without a time, or replies without an attempt, have no place in the order and are
    left out.  The same qid at another time is another question.
    """
    asked = questions.filter("asked_at IS NOT NULL").select("qid", "asked_at")
    given = replies.filter("replied_at IS NOT NULL").select(F.col("qid").alias("to_qid"), "attempt", "answer", "replied_at")
    if questions.isStreaming:
        asked, given = asked.withWatermark("asked_at", late), given.withWatermark("replied_at", late)
    in_time = (F.col("replied_at") >= F.col("asked_at")) & (F.col("replied_at") <= F.col("asked_at") + F.expr(f"INTERVAL {limit}"))
    both = asked.join(given, (F.col("qid") == F.col("to_qid")) & in_time, "left")
    # attempts are tested here: a filter on replies would go below the watermark, which replies of any attempt move
    said = F.col("attempt").between(1, tries) & (F.trim(F.coalesce("answer", F.lit(""))) != "")
    first = F.min(F.when(said, F.struct("attempt", F.col("replied_at").cast("timestamp_ntz").alias("at"), "answer")))
    grouped = both.groupBy("qid", "asked_at").agg(first.alias("first"), F.coalesce(F.bool_or(F.col("attempt") == tries), F.lit(False)).alias("spent"))
    status = F.when(F.col("first").isNotNull(), "replied").when(F.col("spent"), "gave_up").otherwise("timed_out")
    return grouped.select("qid", "asked_at", F.coalesce("first.answer", F.lit(default)).alias("answer"), status.alias("status"))


def settle_stream(questions: DataFrame, replies: DataFrame, table: str, checkpoint: str, **how):
    """Appends what ``settle`` closes to a Parquet table, and ends when all input there is has been read; open questions stay in the checkpoint for the next run."""
    return settle(questions, replies, **how).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def closing(rows: DataFrame, at: str, after: str) -> DataFrame:
    """The sentinel of a finished source: one row, ``after`` its last time, with an empty qid and no other values.

    Written to the questions and to the replies, and later than the limit and the
    lateness together, it closes all questions before it; itself it stays open.
    (A null qid would not do: the join drops such replies before they move the
    watermark.)
    """
    given = {at: F.max(at) + F.expr(f"INTERVAL {after}"), "qid": F.lit("")}
    marks = [given.get(n, F.lit(None)).cast(k).alias(n) for n, k in rows.dtypes]
    return rows.agg(*marks)


def stop_when_idle(query, seconds: float, poll: float = 0.2) -> int:
    """Lets a stream that has no end run until nothing has come for so many seconds, stops it, and returns the number of its last batch (-1: none)."""
    seen, since = -1, time.monotonic()
    while query.isActive and time.monotonic() - since < seconds:
        progress = query.lastProgress
        if progress and progress["numInputRows"] and progress["batchId"] > seen:
            seen, since = progress["batchId"], time.monotonic()
        elif query.status["isTriggerActive"] and query.status["isDataAvailable"]:
            since = time.monotonic()  # a batch is still at work
        time.sleep(poll)
    if query.exception():
        raise query.exception()
    query.stop()
    return seen
