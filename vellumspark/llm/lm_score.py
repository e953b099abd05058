"""LM scoring by context-tree weighting, beside an add-half unigram base, with a model as large as the corpus asks for.

What is scored is the text as its tokens: A-Z lower-cased, words (runs of
anything but white space ``[\\x20\\x09-\\x0D]``) joined by one space, then an end.

The model is never sent whole to anyone.  Every input partition is read once and
cut into blocks of about ``block_bytes``.  Each block asks, once per distinct gram
(context bytes and next byte) and word in it, and gets the answers back:

1. A block counts its grams and words: sorted packed arrays, one for each of
   ``parts`` parts of the key space (grams: by a hash of their newest context
   bytes; words: by ranges of their hash).  Counts are of learning rows only;
   grams of other rows are there with count 0.  Its texts are packed too.
2. Each part merges its arrays over all blocks (a gram's or word's total) and
   mixes them down to the context's cutoff; sums for the nodes above go to
   ``mids`` groups by the two newest bytes, which mix the next levels and answer
   the parts with a factor and an addend for each node.  The top (at most 256 *
   255 nodes, a fixed bound) is sent to all of these.
3. Parts answer the blocks in the order of the blocks' own keys; a block scores
   its documents with array look-ups.

Parts grow with the bytes of the corpus, so that the memory of a task does not:
a block holds ``block_bytes``, a part what ``part_bytes`` of text give and the
grams of one context at most beyond that (256**3, see ``ctw``), a group of mids
256 * 255 nodes for each pair of bytes.  The packed arrays number blocks times
parts: from about 1 TB on, give larger blocks and parts, as executors allow.
Words travel as 63-bit hashes, a polynomial in their bytes.

Defined results: a null text counts as empty and has one token, its end; null and
repeated ids are rows like others, for rows are dealt by place; repeated rows
count and are scored each; without learning rows every bit has probability 1/2
and the base is that of no counts; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw
from .common import crc_mod, cut, drop_cut, table

CHUNK = 1 << 20
GRAM, WORD, MID, TEXT = 0, 1, 2, 3
MOST_MIDS = 1024
#: Keys of merged arrays are added up as soon as so many are held.
HELD_KEYS = 1 << 22
PACKED = "block long, part int, kind int, n long, keys binary, data binary"
MERGED = "part int, kind int, mid int, n long, keys binary, data binary, known long, total long"
SCORES = "id long, learn boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double"
ONE = np.uint64(1)
#: The polynomial's odd base, its inverse modulo 2**64, and a final multiplier.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
FINAL = np.uint64(0xD6E8FEB86659FD93)


def pack_values(values: np.ndarray, kind: str = "f8") -> bytes:
    return kind.encode() + pa.compress(values.astype(kind).tobytes(), "zstd", asbytes=True)


def unpack_values(n: int, data: bytes) -> np.ndarray:
    kind = data[:2].decode()
    return np.frombuffer(pa.decompress(data[2:], n * int(kind[1]), "zstd", asbytes=True), kind)


def pack(keys: np.ndarray, values: np.ndarray, kind: str = "f8") -> tuple[int, bytes, bytes]:
    """Sorted keys as differences, and the values in the given type, both compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return len(keys), pa.compress(steps.tobytes(), "zstd", asbytes=True), pack_values(values, kind)


def unpack(n: int, keys: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(pa.decompress(keys, 8 * n, "zstd", asbytes=True), np.uint64)
    return np.cumsum(steps, dtype=np.uint64), unpack_values(n, data)


def add_up(arrays) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values, of any number of (keys, values); what is held stays near HELD_KEYS or the result's size."""
    held, n, most = [], 0, HELD_KEYS

    def together():
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([v for _, v in held]), len(keys))

    for pair in arrays:
        held.append(pair)
        n += len(pair[0])
        if n > most and len(held) > 1:
            held = [together()]
            n = len(held[0][0])
            most = 2 * max(n, HELD_KEYS // 2)
    return together() if held else (np.zeros(0, np.uint64), np.zeros(0))


def split(keys: np.ndarray, values: np.ndarray, parts: np.ndarray):
    """(part, keys, values) for each part that occurs; keys stay sorted."""
    if not len(keys):
        return
    order = np.argsort(parts, kind="stable")
    found, first = np.unique(parts[order], return_index=True)
    for p, o in zip(found.tolist(), np.split(order, first[1:]), strict=True):
        yield p, keys[o], values[o]


def _mixed(x: np.ndarray) -> np.ndarray:
    return ((x ^ (x >> np.uint64(15))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


def part_of(keys: np.ndarray, parts: int, kind: int, depth: int) -> np.ndarray:
    """Words go by ranges of their hash, grams by a hash of their newest context bytes: subtrees and neighbours stay together."""
    if kind == WORD:
        return (((keys >> np.uint64(31)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    return (_mixed(keys >> np.uint64(8 * (depth + 1 - ctw.cutoff(depth)))) % np.uint64(parts)).astype(np.int64)


def mid_level(depth: int) -> int:
    """The lowest level that the middle groups mix: they have all nodes under a context of so many bytes."""
    return min(2, ctw.cutoff(depth) - 1)


def mid_of(nodes: np.ndarray, mids: int, depth: int) -> np.ndarray:
    """Groups of nodes of level cutoff - 1 (node << 3 | bit number)."""
    drop = (nodes & np.uint64(7)) + np.uint64(3 + 8 * (ctw.cutoff(depth) - 1 - mid_level(depth)))
    return (_mixed(nodes >> drop) % np.uint64(mids)).astype(np.int64)


def _unpacked(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return (unpack(n, k, d) for n, k, d in zip(rows["n"].to_pylist(), rows["keys"].to_pylist(), rows["data"].to_pylist(), strict=True))


def _out(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({c: pa.array(v, k) for c, v, k in zip(names, columns, kinds, strict=True)})


def pack_texts(texts: list[bytes], ids: list, learn: list[bool]) -> tuple[int, bytes, bytes]:
    """Texts have no line feed, which joins them; ids with a byte of flags each (learn, null)."""
    joined = b"\n".join(texts)
    flags = np.array([x + 2 * (i is None) for x, i in zip(learn, ids, strict=True)], np.uint8)
    told = np.array([i or 0 for i in ids], np.int64).tobytes() + flags.tobytes()
    return len(texts), pa.compress(told, "zstd", asbytes=True), len(joined).to_bytes(8, "little") + pa.compress(joined, "zstd", asbytes=True)


def unpack_texts(n: int, keys: bytes, data: bytes) -> tuple[list[bytes], list, np.ndarray]:
    told = pa.decompress(keys, 9 * n, "zstd", asbytes=True)
    flags = np.frombuffer(told, np.uint8, n, 8 * n)
    ids = [None if f & 2 else i for i, f in zip(np.frombuffer(told, np.int64, n).tolist(), flags.tolist(), strict=True)]
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True).split(b"\n"), ids, (flags & 1).astype(bool)


PACKED_OUT = (["block", "part", "kind", "n", "keys", "data"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])
MERGED_OUT = (["part", "kind", "mid", "n", "keys", "data", "known", "total"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])


def _chunks(texts: list[bytes], depth: int):
    """(first row, rows, bytes laid out) of runs of texts of about CHUNK bytes."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK or i == len(texts) - 1:
            yield first, i + 1 - first, ctw.lay_out(texts[first : i + 1], depth)
            first, size = i + 1, 0


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def at_least(self, n: int):
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


def word_hashes(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of the words of texts that are laid out, in order, and the number of each word's text."""
    up, down = powers.at_least(len(data) + 1)
    stops = np.flatnonzero((data == 0x20) | (data >= ctw.START))
    starts = np.concatenate(([0], stops[:-1] + 1))
    some = stops > starts
    starts, ends = starts[some], stops[some]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + ONE) * up[: len(data)], dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(32))) * FINAL
    return (h ^ (h >> np.uint64(29))) >> ONE, np.cumsum(data == ctw.END)[starts]


def _flagged(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys hold a key and, in the lowest bit, 1 if it isn't counted: distinct keys in order, and counts. Sorts in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] ^ keys[:-1]) > ONE)))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return keys[first] >> ONE, np.add.reduceat((keys & ONE) ^ ONE, first).astype(np.int64)


def _block_keys(texts: list[bytes], depth: int, left_out: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct grams and words of a block, and how often they occur in texts that aren't left out."""
    powers, found = Powers(), {GRAM: [], WORD: []}
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    flags = left_out.astype(np.uint64)
    for first, n, data in _chunks(texts, depth):
        mine = flags[first : first + n]
        found[GRAM].append((ctw.gram_keys(data, depth) << ONE) | np.repeat(mine, sizes[first : first + n]))
        words, owner = word_hashes(data, powers)
        found[WORD].append((words << ONE) | mine[owner])
    return {kind: _flagged(np.concatenate(found.pop(kind) or [np.zeros(0, np.uint64)])) for kind in (GRAM, WORD)}


def _count_blocks(depth: int, parts: int, block_bytes: int):
    def block(number: int, texts: list[bytes], ids: list, learn: list[bool]) -> Iterator[pa.RecordBatch]:
        out = [(number, -1, TEXT, *pack_texts(texts, ids, learn))]
        for kind, (keys, n) in _block_keys(texts, depth, ~np.array(learn, bool)).items():
            out += [(number, p, kind, *pack(k, v, "u4")) for p, k, v in split(keys, n, part_of(keys, parts, kind, depth))]
        return iter(_out(out, *PACKED_OUT).to_batches())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, ([], [], []), 0
        for batch in batches:
            for text, i, learn in zip(batch.column("text"), batch.column("id").to_pylist(), batch.column("learn").to_pylist(), strict=True):
                plain = b" ".join(text.as_buffer().to_pybytes().lower().split())
                for column, value in zip(held, (plain, i, learn), strict=True):
                    column.append(value)
                size += len(plain) + 1
                if size >= block_bytes:
                    yield from block(number, *held)
                    number, held, size = number + 1, ([], [], []), 0
        if held[0]:
            yield from block(number, *held)

    return run


def _merge_part(depth: int, mids: int):
    def run(rows: pa.Table) -> pa.Table:
        part, kind = rows["part"][0].as_py(), rows["kind"][0].as_py()
        keys, total = add_up(_unpacked(rows))
        out = [(part, kind, -1, *pack(keys, total), int((total > 0).sum()), int(total.sum()))]
        if kind == GRAM:
            node, *sums = ctw.top_rows(keys, total, depth)
            group = mid_of(node, mids, depth)
            for mid in np.unique(group).tolist():
                mine = group == mid
                out.append((part, MID, mid, int(mine.sum()), pa.compress(node[mine].tobytes(), "zstd", asbytes=True), pack_values(np.concatenate([x[mine] for x in sums])), 0, 0))
        return _out(out, *MERGED_OUT)

    return run


def _mid_nodes(rows: pa.Table, depth: int) -> tuple[list[np.ndarray], ctw.Levels]:
    """The nodes that each part asks about, in its order, and the levels that all parts' sums make."""
    asked = [np.frombuffer(pa.decompress(k, 8 * n, "zstd", asbytes=True), np.uint64) for n, k in zip(rows["n"].to_pylist(), rows["keys"].to_pylist(), strict=True)]
    nodes, at = np.unique(np.concatenate(asked), return_inverse=True)
    sums = [unpack_values(3 * n, d).reshape(3, n) for n, d in zip(rows["n"].to_pylist(), rows["data"].to_pylist(), strict=True)]
    a, b, below = (np.bincount(at, np.concatenate([x[i] for x in sums]), len(nodes)) for i in range(3))
    return asked, ctw.Levels(nodes, a, b, below, ctw.cutoff(depth) - 1, mid_level(depth))


def _mid_top(depth: int):
    def run(rows: pa.Table) -> pa.Table:
        node, a, b, below = _mid_nodes(rows, depth)[1].above
        return pa.table({"node": node.astype(np.int64), "a": a, "b": b, "below": below})

    return run


def _mid_answer(depth: int, top: ctw.Levels):
    def run(rows: pa.Table) -> pa.Table:
        asked, levels = _mid_nodes(rows, depth)
        out = []
        for part, mid, node in zip(rows["part"].to_pylist(), rows["mid"].to_pylist(), asked, strict=True):
            both = np.zeros((2, len(node)))
            for j in range(8):
                mine = (node & np.uint64(7)) == j
                m, c, above = levels.mix(j, node[mine] >> np.uint64(3))
                m_top, c_top, _ = top.mix(j, above)
                both[:, mine] = m * m_top, c * m_top + c_top
            out.append((part, GRAM, mid, len(node), b"", pack_values(both.ravel()), 0, 0))
        return _out(out, *MERGED_OUT)

    return run


def _part_values(depth: int, mids: int, model: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a part and what it answers: a gram's log10 probability, a word's count."""
    merged = next(r for r in model if r["mid"] < 0)
    keys, counts = unpack(merged["n"], merged["keys"], merged["data"])
    if merged["kind"] == WORD:
        return keys, counts
    node, *_ = ctw.top_rows(keys, counts, depth)
    group, m, c = mid_of(node, mids, depth), np.zeros(len(node)), np.zeros(len(node))
    for r in model:
        if r["mid"] >= 0:
            mine = group == r["mid"]
            m[mine], c[mine] = unpack_values(2 * r["n"], r["data"]).reshape(2, r["n"])

    def mix(j: int, nodes: np.ndarray):
        mine = (node & np.uint64(7)) == j
        at = np.searchsorted(node[mine] >> np.uint64(3), nodes)
        return m[mine][at], c[mine][at]

    return keys, ctw.log10_probabilities(keys, counts, depth, mix)


def _answer(depth: int, mids: int):
    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        keys, values = _part_values(depth, mids, model.to_pylist())
        out = []
        for block, part, kind, n, k, d in zip(*(asked[c].to_pylist() for c in PACKED_OUT[0]), strict=True):
            mine, _ = unpack(n, k, d)
            out.append((block, part, kind, n, pack_values(values[np.searchsorted(keys, mine)], "f4" if kind == GRAM else "f8")))
        return _out(out, ["block", "part", "kind", "n", "data"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()])

    return run


def _score_block(depth: int, parts: int, totals: tuple[int, int, int]):
    """totals: tokens, distinct tokens and ends of the learning rows."""
    tokens, distinct, ends = totals

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        texts, ids, learn = unpack_texts(*(packed[c][0].as_py() for c in ("n", "keys", "data")))
        powers, tables = Powers(), {}
        got = {(kind, part): unpack_values(n, d) for kind, part, n, d in zip(*(answers[c].to_pylist() for c in ("kind", "part", "n", "data")), strict=True)}
        for kind, (keys, _) in _block_keys(texts, depth, np.zeros(len(texts), bool)).items():
            found = [(k, got.pop((kind, p))) for p, k, _ in split(keys, keys, part_of(keys, parts, kind, depth))]
            tables[kind] = ctw.KeyTable(*(np.concatenate([f[i] for f in found]) if found else np.zeros(0, (np.uint64, float)[i]) for i in (0, 1)))
        base_of = lambda c: np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
        n_tokens, n_known, base, score = (np.zeros(len(texts)) for _ in range(4))
        n_bytes = np.array([len(t) + 1 for t in texts], np.int64)
        for first, n, data in _chunks(texts, depth):
            to = slice(first, first + n)
            sizes = n_bytes[to]
            score[to] = np.add.reduceat(tables[GRAM].get(ctw.gram_keys(data, depth)), np.cumsum(sizes) - sizes)
            words, owner = word_hashes(data, powers)
            counts = tables[WORD].get(words)
            n_tokens[to] = np.bincount(owner, minlength=n) + 1
            n_known[to] = np.bincount(owner, counts > 0, n) + (ends > 0)
            base[to] = np.bincount(owner, base_of(counts), n) + base_of(np.float64(ends))
        return pa.table({"id": pa.array(ids, pa.int64()), "learn": learn, "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64), "n_bytes": n_bytes, "base_score": base, "score": score})

    return run


def score_corpus(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 6, block_bytes: int = 12 << 20, least_block_bytes: int = 4 << 20, part_bytes: int = 24 << 20) -> DataFrame:
    """Per row: SCORES, bits_per_byte (code length of the text and its end) and train_tokens.

    ``learn`` marks the rows that the model learns from; depth: 2 to 6 bytes of
    context.  A task holds a block, or a part of the keys; small corpora get
    smaller ones, for the sake of all cores.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    learns = F.coalesce(learn, F.lit(False))
    size, ends = docs.agg(F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0)), F.count_if(learns)).first()
    at_once = docs.sparkSession.sparkContext.defaultParallelism
    share = max(least_block_bytes, -(-size // at_once))  # of one core
    parts = max(1, -(-size // min(part_bytes, share)))
    mids = min(MOST_MIDS, parts)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), learns.alias("learn"), text.alias("text"))
    asked = cut(rows.mapInArrow(_count_blocks(depth, parts, min(block_bytes, share)), PACKED))
    # as many tasks as groups, so that what a task reads does not grow with the corpus
    keys = asked.filter(F.col("kind") != TEXT).repartition(2 * parts, "part", "kind")
    merged = cut(keys.groupBy("part", "kind").applyInArrow(_merge_part(depth, mids), MERGED))
    known, total = merged.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    nodes = merged.filter(F.col("kind") == MID).repartition(mids, "mid")
    sums = nodes.groupBy("mid").applyInArrow(_mid_top(depth), "node long, a double, b double, below double")
    top = sums.groupBy("node").agg(F.sum("a"), F.sum("b"), F.sum("below")).orderBy("node").collect()  # 256 * 255 nodes at most
    columns = [np.array(c) for c in zip(*top, strict=True)] or [np.zeros(0)] * 4
    table_of_top = ctw.Levels(columns[0].astype(np.uint64), *(c.astype(float) for c in columns[1:]), mid_level(depth) - 1, 0)
    told = nodes.groupBy("mid").applyInArrow(_mid_answer(depth, table_of_top), MERGED)
    model = merged.filter(F.col("kind") != MID).unionByName(told).repartition(2 * parts, "part", "kind")
    answers = cut(keys.groupBy("part", "kind").cogroup(model.groupBy("part", "kind")).applyInArrow(_answer(depth, mids), "block long, part int, kind int, n long, data binary"))
    texts = cut(asked.filter(F.col("kind") == TEXT))
    drop_cut(asked)
    drop_cut(merged)
    blocks = max(1, texts.count())
    texts, answers = texts.repartition(blocks, "block"), answers.repartition(blocks, "block")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block(depth, parts, (total + ends, known + (ends > 0), ends)), SCORES)
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return scored.withColumn("train_tokens", F.lit(total + ends).cast("long")).withColumn("bits_per_byte", bits)


def op2_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_corpus(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) != 1)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
