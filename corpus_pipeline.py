"""The corpus pipeline: five stages from documents to the documents of a mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared checkpoint folder and reads it again as the
next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import decontaminate as decontamination
from vellumspark.llm import exact_dedup as exact
from vellumspark.llm import langid, mixing, simhash
from vellumspark.llm.common import checkpoint_dir, cut, drop_folder, table

#: Language ID keeps a document whose language has at least this probability among the languages,
LEAST_LANGUAGE_SCORE = 0.3
#: and that is in no language at all with at most this one (held-out noise and held-out documents lie on either side, see the README).
MOST_NONE = 0.98


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.

    Null text and text without a letter goes, so does text that fits no language:
    shuffled or random characters, tables of numbers, logs, keys, code and signs, or
    no language likelier than the threshold.  Text in a language with keys or numbers
    in it stays.
    The model learns from the rows that have text and lang; without any, nothing
    is kept.  Repeated rows are decided each; an empty table stays empty.
    """
    model = langid.fit_language_model(docs, other=True)
    prefix = _fresh(docs, "_", "lang_pred", "score", "none")
    found = langid.predict_language(docs, model, prefix=prefix)
    sure = (F.col(f"{prefix}lang_pred") != "und") & (F.col(f"{prefix}score") >= LEAST_LANGUAGE_SCORE)
    if model.other:
        sure &= F.col(f"{prefix}none") <= MOST_NONE
    return found.filter(sure).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the most code points, then the smallest doc_id (a null one is last), then any one.

    Null and blank texts are one group; an empty table stays empty.
    """
    rows, key = _numbered(docs)
    gone = exact.exact_dedup(rows, carry=key).filter(~F.col("kept")).select(*key)
    return rows.join(gone, list(key), "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row with the smallest doc_id (a null one is last), then any one.

    Null and blank texts are alike, with fingerprint zero; an empty table stays empty.
    """
    rows, key = _numbered(docs)
    found = cut(simhash.near_groups(rows, carry=key).select("root", F.struct(F.col("id").isNull().alias("no_id"), "id", *key).alias("row")))
    stay = found.groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    gone = found.select("row.*").join(stay, list(key), "left_anti").select(*key)
    return rows.join(gone, list(key), "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null texts have none and stay; repeated rows are decided alike; without items
    all documents stay; an empty table stays empty.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, with size, source_size, target and taken: the corpus.

    Null and empty texts have size 0 and go; a null source is a source; repeated
    rows count each; other columns stay, but those of the four names are replaced.
    """
    return mixing.source_mix(docs).filter("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Models, fingerprints and flows have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _fresh(docs: DataFrame, prefix: str, *names: str) -> str:
    """The prefix, lengthened until no column has it with one of the names."""
    taken = {c.lower() for c in docs.columns}
    while any(f"{prefix}{n}".lower() in taken for n in names):
        prefix += "_"
    return prefix


def _numbered(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """docs with two columns that tell its rows apart, and their names: the file and the row in it, which all reads of one input share.

    Rows that come from no file are numbered once, in the checkpoint folder.
    """
    prefix = _fresh(docs, "_", "file", "row")
    key = (f"{prefix}file", f"{prefix}row")
    try:
        return docs.withColumns({key[0]: F.xxhash64("_metadata.file_path"), key[1]: F.col("_metadata.row_index")}), key
    except AnalysisException:
        return cut(docs.withColumns({key[0]: F.lit(0).cast("long"), key[1]: F.monotonically_increasing_id()})), key


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage wrote is deleted when the next one has been written."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            drop_folder(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
