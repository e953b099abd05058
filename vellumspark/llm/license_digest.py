"""License scans: canonical digest lookup of entire texts.

A text is made canonical (lower case; lines that state a copyright dropped;
everything but letters and digits to single spaces; equivalent spellings to one)
and its SHA-256 is joined to the digests of known licences.  A text matches only
as a whole.  The table of known texts is made canonical by the same columns (long
licences are known by digest only); it is given by the caller or fixed here, and broadcast only under ``most_known``
rows, else joined by shuffle, where a digest that many texts share still meets
one row.

Defined results: a null or blank text has the digest of the empty text and no
licence; several known ids with one digest give the first by name; repeated rows
are looked up each; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import LICENSES, LONG_LICENSES, SPELLINGS, TITLES

# a line that opens with a copyright mark (of "(c)" only before a year: lists have it too), or with the word and has a mark or a
# year (wrapped prose may open with the word alone), and the line that reserves all rights
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:(?:copyright\b[^\n]*(?:\(c\)|©|(?:19|20)[0-9]{2})|\(c\)[ \t]*(?:19|20)[0-9]{2}|©)[^\n]*|all rights reserved[ \t.]*)$"
NOT_WORDS = r"[^\p{L}\p{N}]+"
# single words first, so that what they become can be part of longer spellings
ORDERED = sorted(SPELLINGS, key=lambda s: (s.count(" "), -len(s), s))
ANY_SPELLING = r" (?:" + "|".join(ORDERED) + r") "


def _wide(words: str) -> str:
    """Two spaces between words and one at each end: neighbours then share no space, so that equal ones in a row are all replaced."""
    return f" {words.replace(' ', '  ')} "


def canonical_text(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(lowered, COPYRIGHT_LINE, ""), NOT_WORDS, " ")), F.lit(" "))
    one = F.replace(spaced, F.lit(" "), F.lit("  "))
    for spelling in ORDERED:
        one = F.replace(one, F.lit(_wide(spelling)), F.lit(_wide(SPELLINGS[spelling])))
    return F.trim(F.when(spaced.rlike(ANY_SPELLING), F.replace(one, F.lit("  "), F.lit(" "))).otherwise(spaced))


def canonical_plain(text: str) -> str:
    """The same for a text of ASCII letters, without Spark."""
    one = _wide(re.sub("[^a-z0-9]+", " ", re.sub(COPYRIGHT_LINE, "", text.lower())).strip())
    for spelling in ORDERED:
        one = one.replace(_wide(spelling), _wide(SPELLINGS[spelling]))
    return one.replace("  ", " ").strip()


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license_id, text, text_digest: one of these two is null. Without texts given, the fixed ones, with their titles and without, and the long licences."""
    rows = [(k, t, None) for k, t in sorted(texts.items())] if texts is not None else [*((k, t, None) for k, t in _titled()), *((k, None, d) for k, ds in LONG_LICENSES.items() for d in ds)]
    return spark.createDataFrame(rows, "license_id string, text string, text_digest string")


def _titled() -> list[tuple[str, str]]:
    return [(k, f"{title}\n\n{t}".strip()) for k, t in sorted(LICENSES.items()) for title in ["", *TITLES.get(k, [])]]


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_known: int = 50_000) -> DataFrame:
    """Per row: id, text_digest and license_id (null: none). known: license_id, text and, if given, text_digest for rows without text."""
    digest = lambda c: F.sha2(canonical_text(F.col(c)), 256)
    told = F.col("text_digest") if "text_digest" in known.columns else F.lit(None).cast("string")
    known = known.select("license_id", F.when(F.length(canonical_text(F.col("text"))) > 0, digest("text")).otherwise(told).alias("text_digest"))
    digests = known.filter("text_digest IS NOT NULL").groupBy("text_digest").agg(F.min("license_id").alias("license_id"))
    if digests.limit(most_known + 1).count() <= most_known:
        digests = F.broadcast(digests)
    return docs.select(id_col, digest(text_col).alias("text_digest")).join(digests, "text_digest", "left").select(id_col, "text_digest", "license_id")


def derived_texts() -> list[tuple[int, str]]:
    """Whole licence texts under negative ids, as ``documents`` has none: as known; in other case, spelling and marks under copyright lines; with a word more."""
    out = []
    for i, (_, text) in enumerate(_titled()):
        dressed = "Copyright (c) 2001 Someone\n(C) 2002 Other\nAll rights reserved.\n\n" + text.upper().replace("LICENSE", "LICENCE").replace(",", " ;").replace(". ", ".\n   ")
        out += [(-1 - 3 * i, text), (-2 - 3 * i, dressed), (-3 - 3 * i, text + "\nIndeed.")]
    return out


def op6_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and whole licence texts of ``derived_texts``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scan_licenses(docs.unionByName(spark.createDataFrame(derived_texts(), "doc_id long, text string")), known_licenses(spark))


def _oracle() -> str:
    digests = {hashlib.sha256(canonical_plain(t).encode()).hexdigest(): k for k, t in reversed(_titled())} | {d: k for k, ds in LONG_LICENSES.items() for d in ds}
    known = ", ".join(f"('{d}', '{k}')" for d, k in digests.items())
    derived = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in derived_texts())
    one = "replace(spaced, ' ', '  ')"
    for spelling in ORDERED:
        one = f"replace({one}, '{_wide(spelling)}', '{_wide(SPELLINGS[spelling])}')"
    return rf"""
WITH spaced AS (
  SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT_LINE}', '', 'g'), '{NOT_WORDS}', ' ', 'g')) || ' ' AS spaced
  FROM (SELECT doc_id, text FROM documents UNION ALL VALUES {derived})),
d AS (SELECT doc_id, sha256(trim(replace({one}, '  ', ' '))) AS text_digest FROM spaced),
known(text_digest, license_id) AS (VALUES {known})
SELECT doc_id, text_digest, license_id FROM d LEFT JOIN known USING (text_digest)
"""


ORACLE = _oracle()
