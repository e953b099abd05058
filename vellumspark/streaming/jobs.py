"""Streams: new documents to a chunk table, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_articles
from ..operators.tables import upsert
from ..schemas import from_documents
from ..storage import drop_folder, exists, is_folder

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, pattern: str, schema: str, files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(folder)


def table_source(spark: SparkSession, path: str, schema: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of a Parquet table that is one file or a folder of files."""
    if is_folder(spark, path):
        return source(spark, path, "*", schema, files_at_once)
    folder, name = path.rstrip("/").rsplit("/", 1)
    return source(spark, folder, name, schema, files_at_once)


def chunk_stream(documents: DataFrame, table: str, checkpoint: str, profile: str = "stem"):
    """Appends the chunks of new documents; the checkpoint remembers which files are done. Runs until nothing is left."""
    chunks = chunk_articles(from_documents(documents), profile)
    return chunks.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_stream(rows: DataFrame, table: str, checkpoint: str, key: str, version: str, buckets: int = 64):
    """Keyed last-wins upsert of each micro-batch into a table of ``buckets`` by a hash of the key; only the buckets that a batch meets are written.

    Merged buckets are written aside first, under the batch's number, and then
    replace those of the table: a batch that is run again finishes from there, so
    a failure in between loses nothing.  Data that can't be read is an error.
    """

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))

    def write(batch: DataFrame, number: int) -> None:
        spark, aside = batch.sparkSession, f"{checkpoint}/merged/n={number}"
        if not exists(spark, f"{aside}/_SUCCESS"):
            fresh = bucketed(batch)
            met = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # buckets at most
            held = spark.read.parquet(table).filter(F.col("bucket").isin(met)) if exists(spark, table) else fresh.limit(0)
            upsert(held, fresh, key, version).write.mode("overwrite").partitionBy("bucket").parquet(aside)
        merged = spark.read.schema(bucketed(batch).schema).parquet(aside)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
        if exists(spark, f"{checkpoint}/merged/n={number - 1}"):
            drop_folder(spark, f"{checkpoint}/merged/n={number - 1}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()


def upserted(spark: SparkSession, table: str) -> DataFrame:
    """The table that ``upsert_stream`` has written."""
    return spark.read.parquet(table).drop("bucket")


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling windows by type; a batch frame gives all windows, a stream closes them by the watermark."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counted = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counted = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), "n")
