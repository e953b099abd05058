"""Sources and sinks, thin over Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None, skip_bad: bool = False) -> DataFrame:
    """Files, folders or globs; only the named columns are scanned. skip_bad: unreadable files are left out."""
    reader = spark.read.option("ignoreCorruptFiles", str(skip_bad).lower())
    df = (reader.schema(schema) if schema else reader).parquet(path)
    return df.select(*columns) if columns else df


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(place, path, n_bytes) of a folder's files and those below it, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("n_bytes")).withColumn("place", F.row_number().over(Window.orderBy("path")) - 1).select("place", "path", "n_bytes")


def silent_files(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """(path) of the Parquet files that give no row: unreadable, or empty. Of readable files only footers are read."""
    reader = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    heard = reader.schema(schema).parquet(folder).select(F.col("_metadata.file_path").alias("path")).distinct()
    return list_files(spark, folder, pattern).join(heard, "path", "left_anti").select("path")


def read_state(spark: SparkSession, path: str, name: str = "title") -> DataFrame:
    """The strings of a JSON list, one a row."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias(name))


def write_state(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """A column of strings as one JSON list; over ``most`` of them is an error: a larger state is a table."""
    name = df.columns[0]
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} entries")
    df.agg(F.to_json(F.array_sort(F.collect_list(name)))).coalesce(1).write.mode("overwrite").text(path)


def export_json(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A subset as one JSON array; over ``most`` rows is an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows")
    df.agg(F.to_json(F.collect_list(F.struct(*df.columns)))).coalesce(1).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def read_results(spark: SparkSession, path: str, schema: str = "qid string, answer string") -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_lines(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """Trimmed lines, blanks dropped."""
    return spark.read.option("lineSep", "\n").text(path).select(F.trim("value").alias(name)).filter(F.col(name) != "")


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) for each file, without a byte order mark."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def seeds(spark: SparkSession, values: list[str] | DataFrame, name: str = "node") -> DataFrame:
    """Seeds, each once: a list from the settings, or a table's first column."""
    if isinstance(values, DataFrame):
        return values.select(values[values.columns[0]].alias(name)).distinct()
    return spark.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{name} string")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int | None = None) -> None:
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_results(df: DataFrame, path: str, mode: str = "append", bom: bool = False) -> None:
    """CSV with a header. bom: the first header name begins with a byte order mark, as spreadsheet programs like it."""
    df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    df.write.mode(mode).option("header", "true").csv(path)


def replace_table(df: DataFrame, path: str, staging: str) -> None:
    """Overwrite a table that df may read: the rows are written aside first."""
    df.write.mode("overwrite").parquet(staging)
    df.sparkSession.read.parquet(staging).write.mode("overwrite").parquet(path)


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    """(n_files, n_bytes) of a folder and those below it, by the store's listing; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def category_members(listing: DataFrame, json_col: str = "reply", namespaces: dict[int, str] | None = None) -> DataFrame:
    """(category, title, kind) from the replies of a category listing: JSON with a list of members (ns, title); other name spaces are left out."""
    kinds = namespaces or {0: "article", 14: "category"}
    members = F.from_json(json_col, "query struct<categorymembers:array<struct<ns:int,title:string>>>")["query"]["categorymembers"]
    kind = F.lit(None).cast("string")
    for number, name in kinds.items():
        kind = F.when(F.col("m.ns") == number, name).otherwise(kind)
    return listing.select("category", F.explode(members).alias("m")).select("category", "m.title", kind.alias("kind")).filter("kind IS NOT NULL")
