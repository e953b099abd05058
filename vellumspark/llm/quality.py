"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

Tokens are runs of word characters and runs of other visible characters of the
lower-cased text; single tokens and pairs are hashed to 2**18 slots; a text is
the vector of ln(1 + count), scaled to length 1.  The model is fitted in one task
on at most ``most_rows`` labelled rows, chosen by a hash of the id; scoring is a
sparse dot product with the weights (1 MB) in every task.

Defined results: a null text counts as empty; an empty text gets the score of
the bias alone; labels that are null are left out, of several labels of one id
the largest holds and of several texts the first in order; without learning rows every score is 0.5; repeated rows are
scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, table, with_fields
from .ftrl import Ftrl, list_values, probabilities

BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MOST_KEPT = 400_000


class TokenHashes(dict):
    """Token to 64-bit hash; forgets all when it holds MOST_KEPT."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MOST_KEPT:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value


def features(text: str, hashes: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    tokens = TOKEN.findall(text.lower())
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * MIX1 + h[1:]) * MIX2
    slots, counts = np.unique(np.concatenate((h * MIX1 >> np.uint64(64 - BITS), pairs >> np.uint64(64 - BITS))), return_counts=True)
    value = np.log1p(counts)
    return slots.astype(np.int64), value / (np.sqrt(value @ value) or 1.0)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = TokenHashes()
    for batch in batches:
        rows = [features(x or "", hashes) for x in batch.column("text").to_pylist()]
        if rows:
            arrays = [batch.column("draw"), batch.column("label"), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["draw", "label", "slots", "counts"])


def _train(settings: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(batch.column("draw").to_pylist(), batch.column("label").to_pylist(), list_values(batch.column("slots")), list_values(batch.column("counts")), strict=True)
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        model = Ftrl(1 << BITS, 1, alpha=settings["alpha"], l1=settings["l1"], l2=settings["l2"])
        w = model.fit([(slots, value, label) for _, label, slots, value in rows], settings["epochs"])
        yield pa.RecordBatch.from_arrays([pa.array([w[:, 0].astype(np.float32).tobytes()])], ["weights"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 12_000, alpha: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3) -> np.ndarray:
    """Weights (slots + bias) from labelled rows, label 0 or 1."""
    draw = F.conv(F.substring(F.md5(F.col("key").cast("string")), 1, 12), 16, 10).cast("long")
    marked = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).filter("key IS NOT NULL AND label IN (0, 1)").groupBy("key").agg(F.max("label").alias("label"))
    sample = marked.withColumn("draw", draw).orderBy("draw", "key").limit(most_rows)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "key")
    once = texts.groupBy("draw", "key").agg(F.min("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text"))  # most_rows at most, however often an id occurs
    rows = once.select("draw", "label", "text").mapInArrow(_featurise, "draw long, label int, slots array<long>, counts array<double>")
    got = cut(rows.repartition(1).mapInArrow(_train({"alpha": alpha, "l1": l1, "l2": l2, "epochs": epochs}), "weights binary")).first()
    return np.frombuffer(got["weights"], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the column ``name`` (0 to 1, higher: label 1 likelier) added or replaced."""
    docs, schema = with_fields(docs, (name, "double"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            logits = np.zeros((batch.num_rows, 1))
            for i, text in enumerate(batch.column(at).to_pylist()):
                slots, value = features(text or "", hashes)
                logits[i, 0] = value @ weights[slots] + weights[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probabilities(logits)[:, 0])], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op5_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    weights = fit_quality(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    scored = score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), weights)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
