"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of 1 to 3 code points of the lower-cased text, hashed to 2**14
slots; value (1 + ln tf) * idf, scaled to length 1.  One pass over all learning
rows gathers document frequencies (all of them) and the features of a bounded
sample: about ``per_label`` rows of each language, ``most_rows`` in all, chosen
by a hash of id and text, and at least one row of every language.  One task trains the model on that sample with
follow-the-regularised-leader and elastic-net penalties; a fifth of the sample,
unseen in training, sets the temperature.  The model (2**14 slots times the
number of languages) is what scoring tasks get.

With ``other`` the model learns one class more, from copies of a quarter of the
sample with their characters shuffled and from random letters and digits: texts in
no language at all.  It is never predicted; its probability is a column.

Defined results: text that is null or has no letter gives ``und`` and score 0;
rows without lang or text are not learned from; without any learning row all
texts give ``und``; with one language its score is 1; null and repeated ids are
told apart by their texts, rows with equal id, text and language are sampled as
one; repeated rows are scored each; an empty table gives an empty result; other
columns are not read.  A letter is a character of Unicode category L.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut, drop_cut, table, with_fields
from .ftrl import Ftrl, fit_temperature, list_values, probabilities

SLOTS = 1 << 14
CHUNK = 1 << 20
#: Texts of at most so many code points are counted by sorting.
SHORT = 256
#: Label of the class of texts in no language: no code point of a language's name.
OTHER = "\uffff"
A, B, C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots that occur and how often."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(SLOTS, np.int64) if len(points) > SHORT else None
    for at in range(0, len(points), CHUNK):
        p = points[at : at + CHUNK + 2]
        one = p * A
        two = one[:-1] * B + p[1:] * C
        three = two[:-1] * B + p[2:] * A
        h = np.concatenate((one[:CHUNK], two[:CHUNK], three[:CHUNK]))
        h ^= h >> np.uint32(15)
        h *= C
        h += np.repeat(np.arange(1, 4, dtype=np.uint32), (len(one[:CHUNK]), len(two[:CHUNK]), len(three[:CHUNK])))
        h >>= np.uint32(18)
        if total is None:
            return np.unique(h, return_counts=True)
        total += np.bincount(h, minlength=SLOTS)
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slots = np.flatnonzero(total)
    return slots, total[slots]


def tf_idf(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1.0 + np.log(counts)) * idf[slots]
    return value / (np.sqrt(value @ value) or 1.0)


def nonsense(text: str, seed: int) -> str:
    """About as many characters in no language: the text's own in another order, random letters and digits, tables of numbers, keys, or lines of made-up code."""
    rng = np.random.default_rng(seed)
    n, kind = min(len(text), CHUNK), (seed >> 3) % 5
    if kind == 0:
        return "".join(np.array(list(text[:n]))[rng.permutation(n)])
    if kind == 1:
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789 "), size=n))
    if kind == 2:
        return "".join(rng.choice(list("0123456789" * 3 + ".,-/:;%+ \t\n" + " " * 4), size=n))
    if kind == 3:
        signs = "0123456789abcdef" if seed & 4096 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        made, width = "".join(rng.choice(list(signs), size=n)), int(rng.integers(16, 65))
        return "\n".join(made[i : i + width] for i in range(0, n, width))
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz_0"), size=n))
    joints = rng.choice(["(", ")", " = ", ";\n", "{\n  ", "}\n", "[", "] ", ".", "->", " + ", " != ", ", ", "();\n", ": ", " 0x", " 10 "], size=n // 3 + 1).tolist()
    steps = np.cumsum(rng.integers(1, 8, size=n // 3 + 1)).tolist()
    return "".join(letters[i:j] + x for i, j, x in zip([0, *steps], steps, joints, strict=False) if i < n)[:n]


def _gather(other: bool):
    """One row of document frequencies for each task, and the features of each row that is in the sample."""

    def out(label, split, slots, counts):
        return pa.RecordBatch.from_arrays([pa.array([label], pa.string()), pa.array([split], pa.int64()), pa.array([slots], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int64()))], ["label", "split", "slots", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, told = np.zeros(SLOTS, np.int64), 0, set()
        for batch in batches:
            for text, label, split in zip(batch.column("text"), batch.column("label").to_pylist(), batch.column("split").to_pylist(), strict=True):
                slots, counts = ngram_counts(text.as_py())
                df[slots] += 1
                rows += 1
                if split is not None and (label, split) not in told:  # equal rows have one draw
                    told.add((label, split))
                    yield out(label, split, slots, counts)
                    if other and split & 3 == 0 and len(slots):
                        yield out(OTHER, split >> 2, *ngram_counts(nonsense(text.as_py(), split)))
        slots = np.flatnonzero(df)
        yield out(None, rows, slots, df[slots])

    return run


def _train(languages: list[str], idf: np.ndarray, settings: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = {x: i for i, x in enumerate(languages)}, []
        for batch in batches:
            slots, counts = list_values(batch.column("slots")), list_values(batch.column("counts"))
            rows += zip(batch.column("split").to_pylist(), batch.column("label").to_pylist(), slots, counts, strict=True)
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[3].sum()))
        some = {label for split, label, *_ in rows if split % 5}  # a language without such rows is learned from those it has
        data = [(split % 5 == 0, label in some, (slots, tf_idf(slots, counts, idf), place[label])) for split, label, slots, counts in rows]
        learn = [x for held, other, x in data if not (held and other)]
        model = Ftrl(SLOTS, len(languages), alpha=settings["alpha"], l1=settings["l1"], l2=settings["l2"])
        w = model.fit(learn, settings["epochs"])
        held = [x for h, _, x in data if h]
        logits = np.array([v @ w[i] + w[-1] for i, v, _ in held]).reshape(-1, len(languages))
        t = fit_temperature(logits, np.array([y for *_, y in held], np.int64)) if len(languages) > 1 else 1.0
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([t])], ["weights", "temperature"])

    return run


class LanguageModel:
    """Languages, idf, weights (float32, slots + bias by languages and, if other, the class of no language) and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float, other: bool = False):
        self.languages, self.idf, self.weights, self.temperature, self.other = languages, idf, weights, temperature, other

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.weigh(text)[:2]

    def weigh(self, text: str | None) -> tuple[str, float, float]:
        """Language, its probability among the languages, and the probability that the text is in none."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, 1.0
        if len(self.languages) == 1 and not self.other:
            return self.languages[0], 1.0, 0.0
        slots, counts = ngram_counts(text)
        logits = tf_idf(slots, counts, self.idf) @ self.weights[slots] + self.weights[-1]
        p = probabilities(logits[None], self.temperature)[0]
        none = float(p[-1]) if self.other else 0.0
        p = probabilities(logits[None, : len(self.languages)], self.temperature)[0] if len(self.languages) > 1 else np.ones(1)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), none


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_label: int = 1500, most_rows: int = 12_000, most_labels: int = 1000, alpha: float = 2.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3, other: bool = False) -> LanguageModel:
    """Learn from all given rows that have text and language; other: learn texts in no language too."""
    known = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("label"), F.col(id_col).cast("string").alias("id")).filter("text IS NOT NULL AND label IS NOT NULL")
    draw = F.shiftrightunsigned(F.xxhash64("label", "id", "text"), 32)
    known = known.select("text", "label", draw.alias("draw"))
    counts = {r["label"]: (r["n"], r["least"]) for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).limit(most_labels + 1).collect()}
    if len(counts) > most_labels:
        raise ValueError(f"over {most_labels} languages")
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros(SLOTS), np.zeros((SLOTS + 1, 0), np.float32), 1.0)
    want = max(1, min(per_label, most_rows // len(languages)))
    spark = docs.sparkSession
    # the row of least draw is always in, so that no language is without one
    bounds = spark.createDataFrame([(k, max(want / n * (1 << 32), float(least))) for k, (n, least) in counts.items()], "label string, bound double")
    drawn = known.join(F.broadcast(bounds), "label").select("text", "label", F.when(F.col("draw") <= F.col("bound"), F.col("draw")).alias("split"))
    gathered = cut(drawn.mapInArrow(_gather(other), "label string, split long, slots array<int>, counts array<long>"))
    rows = gathered.filter("label IS NULL").agg(F.sum("split")).first()[0] or 0
    pairs = gathered.filter("label IS NULL").select(F.explode(F.arrays_zip("slots", "counts")).alias("x")).groupBy("x.slots").agg(F.sum("x.counts").alias("df")).collect()
    df = np.zeros(SLOTS)
    for slot, n in pairs:
        df[slot] = n
    idf = np.log((1.0 + rows) / (1.0 + df)) + 1.0
    # the draw gives about ``want`` rows of each language; the rank makes the bound strict
    rank = F.row_number().over(Window.partitionBy("label").orderBy("split"))
    sample = gathered.filter("label IS NOT NULL").groupBy("label", "split").agg(F.first("slots").alias("slots"), F.first("counts").alias("counts"))
    sample = sample.withColumn("rank", rank).filter(F.col("rank") <= 2 * want).drop("rank")
    settings = {"alpha": alpha, "l1": l1, "l2": l2, "epochs": epochs}
    if other and sample.filter(F.col("label") == OTHER).limit(1).count():
        languages = [*languages, OTHER]
    got = cut(sample.repartition(1).mapInArrow(_train(languages, idf, settings), "weights binary, temperature double")).first()
    weights = np.frombuffer(got["weights"], np.float32).reshape(SLOTS + 1, len(languages))
    drop_cut(gathered)
    known_ones = [x for x in languages if x != OTHER]
    return LanguageModel(known_ones, idf, weights, got["temperature"], len(known_ones) < len(languages))


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the columns lang_pred and score (named with the prefix) added or replaced, and ``none`` if the model has texts in no language."""
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "none")][: 3 if model.other else 2]
    docs, schema = with_fields(docs, *zip(names, ("string", "double", "double"), strict=False))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.weigh(None if x is None else str(x)) for x in batch.column(at).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.float64())
            arrays = [*batch.columns, *(pa.array([x[i] for x in found], kinds[i]) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op10_langid_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit_language_model(docs.filter(~held_out))
    return predict_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
