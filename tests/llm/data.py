"""Small tables that hold every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "Alpha beta gamma delta", "en", "a", 22),
    (2, "alpha  beta gamma\ndelta", "en", "b", 23),
    (3, "Alpha beta gamma delta", "en", "a", 22),
    (4, None, "en", None, None),
    (5, "", None, "a", 0),
    (6, " \t\n", "fr", "b", 3),
    (7, "word " * 40_000, "en", "a", 200_000),
    (8, "x" * 150_000, None, None, 150_000),
    (9, "naïve Ünïcode — ß 漢字 😀", "de", "c", 22),
    (9, "naïve Ünïcode — ß 漢字 😀", "de", "c", 22),
    (None, "Alpha beta gamma delta!", "en", "a", 23),
    (11, "123 456 !!! ???", "en", "z", 15),
]
#: Names that operators use inside
CLASH = ["id", "fp", "n", "digest", "label", "slot", "score", "size", "taken", "block", "component_id", "text_sha256", "kept", "lang_pred", "best", "row_id", "bucket", "draw"]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def clashing(spark):
    from pyspark.sql import functions as F

    return odd(spark).withColumns({c: F.lit("clash") for c in CLASH})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(n, seed=0, words=30, vocabulary=400):
    rng = random.Random(seed)
    known = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return [" ".join(rng.choices(known, k=rng.randint(3, words))) for _ in range(n)]


def write(spark, tmp_path, **tables):
    """A folder with the given DataFrames as driver tables."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
