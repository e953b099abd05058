"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import checkpoint_dir, cut, drop_cut, drop_folder, stored  # noqa: F401

#: ASCII white space that separates words, as a character class of Java and RE2.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of few partitions (eight, about 1 GB, at most, and half as many as there are cores) is dealt to all cores. Larger ones stay as the reader splits them, whatever the cluster."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= min(cores // 2, 8) else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def word_count(text: Column) -> Column:
    """Runs of anything but white space; null has none. By splitting: counting matches copies the text for each of them."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"{SPACE_CLASS}+"))).cast("long")


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n_col: str, parts: int = 1000) -> DataFrame:
    """Inner join of rows to one row per key, when single keys may hold a large share of all rows.

    ``groups`` is unique on ``keys`` and has the number of rows of each key in
    ``n_col``.  Keys with over 1/parts of all rows number at most ``parts``, so
    that side is broadcast with a proven bound; all other keys are shuffled and
    none of them exceeds 1/parts of the rows.
    """
    total = groups.agg(F.sum(n_col)).first()[0] or 0
    limit = max(1, total // parts)
    hot = groups.filter(F.col(n_col) > limit)
    by_broadcast = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return by_broadcast.unionByName(rest.join(groups.filter(F.col(n_col) <= limit), keys, "inner"))


def hot_keys(rows: DataFrame, keys: list[str], most: int = 1000, least: int = 100) -> DataFrame | None:
    """The keys with most rows: ``most`` of them, of those with over ``least`` rows; None if there are none. Any other key has at most 1/most of all rows."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    hot = n.orderBy(F.desc("n")).limit(most).drop("n")
    found = hot.collect()
    return rows.sparkSession.createDataFrame(found, hot.schema) if found else None


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], how: str, hot: DataFrame | None) -> DataFrame:
    """Join (inner or left) of rows to ``groups``, one row per key, where the rows' ``hot_keys`` meet their groups by broadcast and so are not gathered."""
    if hot is None:
        return rows.join(groups, keys, how)
    hot = F.broadcast(hot)
    there = rows.join(hot, keys, "left_semi").join(F.broadcast(groups.join(hot, keys, "left_semi")), keys, how)
    return there.unionByName(rows.join(hot, keys, "left_anti").join(groups, keys, how))


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> tuple[DataFrame, StructType]:
    """df without columns of these names, and its schema with them added at the end."""
    df = df.drop(*(name for name, _ in fields))
    schema = StructType(list(df.schema.fields))
    for name, kind in fields:
        schema = schema.add(name, kind)
    return df, schema

