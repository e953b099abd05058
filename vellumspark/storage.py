"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes the shuffle files of a finished query.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellumspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def work_folder(spark: SparkSession, name: str = "work") -> str:
    """A new folder of its own name in the shared one, deleted when the program ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            drop_folder(spark, folder)

    atexit.register(clear)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that lost executors cost no recomputation; the shuffle files that led to it are removed."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")  # holds for the plans made while it is set
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The same as a Parquet table in a work folder: for wide rows of which later reads need some columns only."""
    spark = df.sparkSession
    folder = work_folder(spark, name)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(folder)


def drop_cut(df: DataFrame) -> None:
    """Deletes the checkpoint files of a result of ``cut`` that nothing needs any more."""
    held = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if held.isDefined():
        drop_folder(df.sparkSession, held.get())


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    _store(spark, path).delete(_path(spark, path), True)


def exists(spark: SparkSession, path: str) -> bool:
    return _store(spark, path).exists(_path(spark, path))


def is_folder(spark: SparkSession, path: str) -> bool:
    return exists(spark, path) and _store(spark, path).getFileStatus(_path(spark, path)).isDirectory()


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
