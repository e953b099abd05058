"""Keeps a table of search passages up to date with a folder of document files.

    python -m jobs.passage_feed --source DOCS --target TABLE --checkpoint STATE --config jobs/passage_feed.json

Document files (doc_id, text, lang, source; Parquet) come in over time.  A file
stream takes the files that its checkpoint does not know yet, until none is left.
Of a batch, documents that the ledger has with the same text are skipped; new and
changed ones are cut at their reference section, split at blank lines, freed of
citation marks, and written as passages that are worth indexing, with ids, domain
and content flags.  Passages and ledger are partitioned by batch (passages by
language as well), and a batch that is run again writes the same partitions anew:
a failure at any point is mended by the next run.  A document's valid passages
are those of the last batch that has it.

Rows without an id are left out and counted; of rows with one id within a batch the
one of the newest file counts, then the one of smallest digest; a null text is empty,
and then a document has no passage; other columns are not read.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import text as t
from vellumspark.operators.tables import keep_first
from vellumspark.storage import exists

from .common import command, settings

LOG = logging.getLogger("jobs.passage_feed")
DEFAULTS = {"files_at_once": 200, "least_chars": 50, "rows_per_file": 1_000_000}
DOCUMENTS = "doc_id bigint, text string, lang string, source string"
FLAGS = ["has_math", "has_formula", "has_table", "has_list", "has_legal"]
LEDGER = "doc_id bigint, digest string, batch bigint"
PASSAGES = "doc_id bigint, part int, passage_id string, lang string, domain string, text string, n_chars int, has_math boolean, has_formula boolean, has_table boolean, has_list boolean, has_legal boolean, batch bigint, lang_part string"


def passage_id(doc_id: Column, part: Column) -> Column:
    return t.uuid5(F.concat(F.lit("doc_"), doc_id.cast("string"), F.lit("_"), part.cast("string")))


def split(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, part, passage_id, lang, domain, text, n_chars, flags): the paragraphs worth keeping; part counts all of them."""
    parts = docs.select("doc_id", "lang", "source", F.posexplode(F.split(t.cut_footer(F.coalesce("text", F.lit(""))), "\n\n")).alias("part", "given"))
    kept = parts.filter(t.keep_chunk_stem(F.col("given"), least_chars)).withColumn("text", t.squeeze(t.strip_citations(F.col("given"))))
    flags = t.content_flags(F.col("given"))
    return kept.filter("text <> ''").select(
        "doc_id",
        "part",
        passage_id(F.col("doc_id"), F.col("part")).alias("passage_id"),
        "lang",
        t.domain(t.category_path(F.array("lang", "source"))).alias("domain"),
        "text",
        F.length("text").alias("n_chars"),
        *[flags[f].alias(f) for f in FLAGS],
    )


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, digest, batch) of every document taken, once for each batch that took it."""
    if not exists(spark, f"{target}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{target}/ledger")


def newest(taken: DataFrame) -> DataFrame:
    return taken.groupBy("doc_id").agg(F.max_by("digest", "batch").alias("digest"), F.max("batch").alias("batch"))


def passages(spark: SparkSession, target: str) -> DataFrame:
    """The valid passages: of each document those of the last batch that has it."""
    if not exists(spark, f"{target}/passages"):
        return spark.createDataFrame([], PASSAGES).drop("batch", "lang_part")
    held = spark.read.schema(PASSAGES).parquet(f"{target}/passages")
    return held.join(newest(ledger(spark, target)).select("doc_id", "batch"), ["doc_id", "batch"]).select(*[c for c in held.columns if c not in ("batch", "lang_part")])


def take(batch: DataFrame, number: int, target: str, told: dict) -> None:
    """Writes one batch's new and changed documents; doing it again changes nothing."""
    spark = batch.sparkSession
    batch.persist()
    try:
        rows = batch.filter("doc_id IS NOT NULL").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
        docs = keep_first(rows, ["doc_id"], [-F.unix_micros("at"), "digest"])
        before = newest(ledger(spark, target).filter(F.col("batch") < number)).drop("batch")
        fresh = docs.join(before, ["doc_id", "digest"], "left_anti").withColumn("batch", F.lit(number).cast("long"))
        out = split(fresh, told["least_chars"]).withColumns({"batch": F.lit(number).cast("long"), "lang_part": F.coalesce(F.nullif("lang", F.lit("")), F.lit("none"))})
        write = lambda df, keys, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", told["rows_per_file"]).partitionBy(*keys).parquet(f"{target}/{name}")
        write(out, ["batch", "lang_part"], "passages")
        write(fresh.select("doc_id", "digest", "batch"), ["batch"], "ledger")  # last: it makes the passages valid
        n, without = batch.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
        taken = ledger(spark, target).filter(F.col("batch") == number).count()
        made = spark.read.schema(PASSAGES).parquet(f"{target}/passages").filter(F.col("batch") == number).count() if exists(spark, f"{target}/passages") else 0
        LOG.info("batch %d: read %d rows (%d without id), took %d new or changed documents, wrote %d passages to %s", number, n, without, taken, made, target)
    finally:
        batch.unpersist()


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: str | None = None, **options) -> DataFrame:
    """Takes the files under ``source`` (a folder or a glob) that the checkpoint does not know; the valid passages afterwards."""
    told = settings(spark, config, DEFAULTS) | options
    if exists(spark, f"{target}/ledger") and not exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{target} has batches that the checkpoint {checkpoint} does not know: give the one that belongs to it, or an empty target")
    files = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", told["files_at_once"]).parquet(source)
    rows = files.select("doc_id", "text", "lang", "source", F.col("_metadata.file_modification_time").alias("at"))
    stream = rows.writeStream.foreachBatch(lambda batch, number: take(batch, number, target, told)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    LOG.info("%s is up to date with %s", target, source)
    return passages(spark, target)


if __name__ == "__main__":
    command("passage_feed", {"source": "folder or glob of Parquet documents", "target": "folder of the passage table", "checkpoint": "folder of the stream's state"}, run)
