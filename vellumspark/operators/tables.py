"""Incremental bookkeeping: first-wins dedupe, resume, state upserts, unions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in the given order; aggregation with a partial step, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*[c if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def free_name(wanted: str, *frames: DataFrame) -> str:
    """The name, with underscores added until no frame has a column of it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet; keys are compared as text, a null key stays."""
    held = free_name("done", df)
    return df.join(done.select(F.col(key).cast("string").alias(held)).distinct(), F.col(key).cast("string") == F.col(held), "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Last version of each key over both tables; incoming wins a tie."""
    new = free_name("new", existing, incoming)
    both = existing.withColumn(new, F.lit(0)).unionByName(incoming.withColumn(new, F.lit(1)), allowMissingColumns=True)
    rest, row = [c for c in both.columns if c not in (key, new)], free_name("row", both)
    picked = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, new)).alias(row))
    return picked.select(key, *[F.col(row).getField(c).alias(c) for c in rest])


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(remaining(incoming, existing, key), allowMissingColumns=True)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def batch_numbers(df: DataFrame, order: str, size: int, within: str) -> DataFrame:
    """batch: 0, 1, ... for every ``size`` rows in order, counted within a key."""
    place = F.row_number().over(Window.partitionBy(within).orderBy(order)) - 1
    return df.withColumn("batch", F.floor(place / size).cast("int"))


def carry_forward(df: DataFrame, value: str, within: str, order: str) -> DataFrame:
    """The latest non-null value so far, within a key."""
    span = Window.partitionBy(within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(span))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def length_summary(df: DataFrame, text: str) -> DataFrame:
    n = F.length(text).cast("double")
    quartile = lambda p: F.percentile(n, F.lit(p))
    return df.agg(
        F.count(n).alias("n"),
        F.round(F.avg(n), 4).alias("mean"),
        F.round(F.stddev_samp(n), 4).alias("std"),
        F.min(n).alias("least"),
        quartile(0.25).alias("q1"),
        quartile(0.5).alias("median"),
        quartile(0.75).alias("q3"),
        F.max(n).alias("most"),
    )


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Rows per bin 0 to bins - 1; values outside count in the outer bins."""
    at = F.floor((value - low) / ((high - low) / bins))
    return df.select(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def accuracy(predictions: DataFrame, truth: DataFrame, qid: str = "qid") -> DataFrame:
    """checked, correct and accuracy in percent; both sides compared as trimmed text."""
    joined = predictions.select(qid, F.trim(F.col("answer").cast("string")).alias("p")).join(truth.select(qid, F.trim(F.col("answer").cast("string")).alias("t")), qid)
    right = F.count_if(F.col("p") == F.col("t"))
    return joined.agg(F.count(F.lit(1)).alias("checked"), right.alias("correct")).withColumn("accuracy", F.round(100 * F.col("correct") / F.col("checked"), 4))


def length_ranges(text: Column) -> dict[str, Column]:
    """Texts that are worth a look: under 100 characters, over 1,500, over 800 words."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))
    return {"short": F.length(text) < 100, "long": F.length(text) > 1500, "wordy": words > 800}


def seeded_sample(df: DataFrame, key: str, most: int, seed: int = 7) -> DataFrame:
    """The rows of least hash: the same ones in every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(most)
