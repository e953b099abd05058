"""SimHash near-dedup: anchor-point covering.

Fingerprints (64 bits) link at 3 or fewer differing bits, so of their two
32-bit halves one differs in at most 1 bit.  The anchors of a half are the
codewords of the perfect [31, 26] Hamming code (covering radius 1) times the
32nd bit.  Each fingerprint is replicated to every anchor within covering radius
plus threshold, 1 + 1 = 2; of two linked fingerprints, one's nearest anchor
(its home) then also holds the other, always.  Fingerprints are compared per
anchor, home rows against all rows, over distinct fingerprints only.  That is
2 * 17 copies at most of each distinct fingerprint and 2 ** 27 anchors a half.

The anchor join is a sort-merge join that adaptive execution splits where an
anchor is hot; its condition holds the bit count, so only true links come out.
One fingerprint has at most 43,744 others within 3 bits, whatever the corpus.

Defined results: a null or blank text has fingerprint zero, linked like any
other; rows with fewer words than a shingle hash the whole sequence; repeated
rows share a component; a null id never becomes a component id unless the
component has no other; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import attach_groups, cut, drop_cut, table, with_fields
from .graph import components

CHUNK = 1 << 16


def simhash64(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Bitwise strict majority over XXH64 of all word shingles, repeats included."""
    words = text.lower().split()  # bytes.lower() changes A-Z only; split() cuts at \x20 and \x09-\x0D
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(flat, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    hash_of, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, CHUNK):
        values = np.array([hash_of(flat[a:b], seed) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)], dtype=">u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [simhash64(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column("text")]
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.array(prints, np.uint64).view(np.int64))], [*kept, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    rows, schema = with_fields(docs.select(F.col(id_col).cast("long").alias("id"), *carry, F.col(text_col).cast("string").alias("text")), ("fp", "long"))
    return rows.mapInArrow(_fingerprint, StructType([f for f in schema.fields if f.name != "text"]))


def anchors_of(fp: np.ndarray, homes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For uint64 fingerprints: row index, anchor, whether it is the row's home; every anchor within 2, or the homes only."""
    index, anchor, home = [], [], []
    rows = np.arange(len(fp))
    for half in (0, 1):
        value = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        word, last = value & np.uint64(0x7FFFFFFF), value >> np.uint64(31)
        syndrome = np.zeros(len(fp), np.uint64)
        for place in range(1, 32):
            syndrome ^= ((word >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
        flip = lambda at: np.where(at > 0, np.uint64(1) << (np.maximum(at, 1).astype(np.uint64) - np.uint64(1)), np.uint64(0))
        nearest = word ^ flip(syndrome)

        def add(which, code, bit, is_home, half=half):
            index.append(which)
            anchor.append((np.uint64(half) << np.uint64(33)) | (bit << np.uint64(31)) | code)
            home.append(np.full(len(which), is_home))

        add(rows, nearest, last, True)
        if homes:
            continue
        add(rows, nearest, last ^ np.uint64(1), False)
        for place in range(1, 32):
            other = syndrome ^ np.uint64(place)
            pair = (syndrome > 0) & (other > np.uint64(place))  # place and other differ and together undo the syndrome
            add(rows[pair], word[pair] ^ flip(np.full(pair.sum(), place, np.uint64)) ^ flip(other[pair]), last[pair], False)
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _replicate(name: str, homes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), CHUNK):
                part = fp[at : at + CHUNK]
                index, anchor, _ = anchors_of(part, homes)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part[index].view(np.int64))], ["anchor", name])

    return run


def links(distinct_fp: DataFrame, threshold: int = 3) -> DataFrame:
    """Edges (a, b), a < b, between distinct fingerprints within the threshold (3 at most)."""
    if not 0 <= threshold <= 3:
        raise ValueError("the anchors cover thresholds 0 to 3")
    # replicas are made twice rather than stored: 34 rows a fingerprint go straight to the shuffle
    homes, copies = (distinct_fp.select("fp").mapInArrow(_replicate(name, only), f"anchor long, {name} long") for name, only in (("x", True), ("y", False)))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= threshold
    joined = homes.join(copies, "anchor").filter((F.col("x") != F.col("y")) & near)
    return joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, fp (signed long), root (the component's smallest fp), component_id, n (rows with this fingerprint), and the carried columns."""
    rows = cut(fingerprints(docs, id_col, text_col, carry))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))
    roots = components(links(prints, threshold)).withColumnRenamed("node", "fp")
    tagged = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tagged = cut(tagged.select("root", "fp", "low", "n"))
    ids = tagged.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    linked = cut(attach_groups(tagged, ids, ["root"], "prints").select("fp", "root", "component_id", "n"))
    drop_cut(tagged)
    drop_cut(prints)
    return attach_groups(rows, linked, ["fp"], "n")


def op9_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
