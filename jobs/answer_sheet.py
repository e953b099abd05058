"""Answers a batch of multiple-choice questions by rule, with evidence from the documents, as a sheet to hand in.

    python -m jobs.answer_sheet --questions QUESTIONS --documents DOCS --target SHEET --config jobs/answer_sheet.json

Questions (qid, question, choices; Parquet) are routed by the rules; those that
are open get their best documents by BM25, and the option that shares most words
with question and evidence; questions with a mathematics hint are answered by
the numeric rules, blocked ones with their refusing option.  Written are
``details`` (Parquet, partitioned by route tag), ``submission`` (CSV: qid, answer)
and ``report`` (CSV: answers by tag and status), each replaced as a whole, so that
a run that broke off is mended by the next one and a rerun gives the same.

Questions without an id are left out; of repeated ids the smallest question
counts; a question without choices is answered A; other columns are not read.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import rules as r
from vellumspark.functions import text as t
from vellumspark.operators.retrieval import bm25_search, with_payload
from vellumspark.operators.tables import keep_first
from vellumspark.plans.answering import counters, lettered
from vellumspark.sources.io import write_results
from vellumspark.storage import cut

from .common import command, settings

LOG = logging.getLogger("jobs.answer_sheet")
DEFAULTS = {"k": 3, "preview": 2000, "k1": 1.5, "b": 0.75}


def answers(questions: DataFrame, documents: DataFrame, told: dict) -> DataFrame:
    """(qid, answer, tag, status, evidence): evidence lists the ids of the documents used, best first."""
    known = keep_first(questions.filter("qid IS NOT NULL").select(F.col("qid").cast("string").alias("qid"), "question", F.coalesce("choices", F.array().cast("array<string>")).alias("choices")), ["qid"], ["question", F.to_json("choices")])
    routed = cut(lettered(known).withColumn("route", r.route_rules(F.coalesce("question", F.lit("")), F.col("options"))))
    open_ = routed.filter(~F.col("route.is_unsafe"))
    hits = bm25_search(documents, open_, told["k"], "doc_id", "text", "qid", "question", told["k1"], told["b"])
    found = with_payload(hits, documents, "doc_id", ["text"], told["k"] * routed.count())
    passage = F.substring(t.squeeze(F.col("text")), 1, told["preview"])
    listed = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", passage.alias("passage")))).alias("h"))  # k at most
    both = F.concat_ws(" ", "question", F.transform("h", lambda x: x["passage"]))
    rule = F.when(F.col("route.is_unsafe"), F.col("route.refusal_key")).when(F.col("route.is_stem"), r.math_answer(F.col("question"), F.col("options"))).otherwise(r.overlap_answer(both, F.col("options")))
    ids = F.coalesce(F.array_join(F.transform("h", lambda x: x["chunk_id"].cast("string")), ","), F.lit(""))
    status = F.when(F.col("route.is_unsafe"), "blocked").when(F.col("route.is_stem"), "numeric").otherwise("evidence")
    return routed.join(listed, "qid", "left").select("qid", F.coalesce(rule, F.lit("A")).alias("answer"), F.col("route.tag").alias("tag"), status.alias("status"), ids.alias("evidence"))


def run(spark: SparkSession, questions: str, documents: str, target: str, config: str | None = None, **options) -> DataFrame:
    """Answers all questions and writes the sheet; its details, read back."""
    told = settings(spark, config, DEFAULTS) | options
    asked, docs = spark.read.parquet(questions), spark.read.parquet(documents)
    answers(asked, docs, told).write.mode("overwrite").partitionBy("tag").parquet(f"{target}/details")
    details = spark.read.schema("qid string, answer string, status string, evidence string, tag string").parquet(f"{target}/details")
    write_results(details.select("qid", "answer"), f"{target}/submission", "overwrite")
    report = counters(details)
    write_results(report.coalesce(1), f"{target}/report", "overwrite")  # a row for each tag and status
    for row in report.orderBy("tag", "status").collect():
        LOG.info("%s %s: %d answers", row["tag"], row["status"], row["n"])
    LOG.info("read questions from %s and documents from %s, wrote %d answers to %s", questions, documents, details.count(), target)
    return details


if __name__ == "__main__":
    command("answer_sheet", {"questions": "Parquet questions (qid, question, choices)", "documents": "Parquet documents (doc_id, text)", "target": "folder of the sheet"}, run)
