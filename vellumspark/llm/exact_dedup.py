"""Exact dedup: tree-merge of sorted digest runs.

Every input partition turns its rows into runs sorted by digest, each digest
once with the best row so far.  P = F**R slots then merge in R rounds.  In round
r a run's rows go to the slot whose first r base-F digits are those of the row's
digest range and whose other digits are the run's own, so F runs meet in each
slot, are merged (exchange, sort, streaming aggregate) and keep the smallest
(negative length, id) of each digest.  After R rounds slot i holds digest range
i alone: work and memory per slot stay even, and no slot ever sees all digests.

Equal texts: identical after white space ``[\\x20\\x09-\\x0D]`` is deleted.  A
digest counts as the same text only where SHA-256, the normalised length and a
second 64-bit hash all agree (the verification of each merge).

Defined results: a null text counts as empty, all empty texts form one group; a
null id sorts after all others; of repeated rows with one id one row is kept;
columns other than id and text are not read, so clashing names are harmless; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, attach_groups, cut, shuffle_partitions, table

KEYS = ["digest", "norm_len", "check"]
RUN_SCHEMA = "slot long, bucket long, digest binary, norm_len long, check long, neg_points long, no_id boolean, id long, row_id long, n long"


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, digest of the normalised text, lengths, a row number that stays fixed, and the carried columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.length(text).cast("long").alias("points"), F.regexp_replace(text, f"{SPACE_CLASS}+", "").alias("norm"), *carry)
    return rows.select(
        "id",
        "points",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.length("norm").cast("long").alias("norm_len"),
        F.xxhash64("norm").alias("check"),
        F.monotonically_increasing_id().alias("row_id"),
        *carry,
    )


def _make_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch becomes one sorted run with a row per digest."""
    for batch in batches:
        order = [(k, "ascending") for k in (*KEYS, "neg_points", "no_id", "id", "row_id")]
        runs = pa.Table.from_batches([batch]).sort_by(order)
        first = [(c, "first") for c in ("slot", "bucket", "neg_points", "no_id", "id", "row_id")]
        options = pa.compute.ScalarAggregateOptions(skip_nulls=False)
        best = runs.group_by(KEYS, use_threads=False).aggregate([(c, f, options) for c, f in first] + [("n", "sum")])
        best = best.rename_columns([c.removesuffix("_first").removesuffix("_sum") for c in best.column_names])
        yield from best.select(batch.schema.names).to_batches()


def merge_runs(rows: DataFrame, fan_in: int = 4, slots: int | None = None) -> DataFrame:
    """One row per distinct text: KEYS, best (struct), group_size."""
    want, rounds = slots or shuffle_partitions(rows.sparkSession), 1
    while fan_in**rounds < want:
        rounds += 1
    p = fan_in**rounds
    prefix = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    runs = rows.select(
        (F.spark_partition_id() % p).cast("long").alias("slot"),
        F.shiftright(prefix * p, 32).alias("bucket"),
        *KEYS,
        (-F.col("points")).alias("neg_points"),
        F.col("id").isNull().alias("no_id"),
        "id",
        "row_id",
        F.lit(1).cast("long").alias("n"),
    ).mapInArrow(_make_runs, RUN_SCHEMA)
    runs = runs.select("slot", "bucket", *KEYS, F.struct("neg_points", "no_id", "id", "row_id").alias("best"), "n")
    for r in range(1, rounds + 1):
        tail = fan_in ** (rounds - r)
        to = F.expr(f"(bucket div {tail}) * {tail} + slot % {tail}")
        runs = (
            runs.withColumn("slot", to)
            .repartitionById(p, F.col("slot").cast("int"))
            .sortWithinPartitions("slot", "bucket", *KEYS)
            .groupBy("slot", "bucket", *KEYS)
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
    return runs.select(*KEYS, "best", F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256, and the carried columns."""
    rows = cut(digest_rows(docs, id_col, text_col, carry))
    groups = cut(merge_runs(rows, fan_in))
    joined = attach_groups(rows.select("id", "row_id", *KEYS, *carry), groups, KEYS, "group_size")
    return joined.select(
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *carry,
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
