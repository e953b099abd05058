"""Phrase collocation mining: a minimal perfect hash over Apriori-safe candidates.

1. Texts become runs of 64-bit word hashes, 0 between pieces; the hash covers the
   language, so everything below is per language.  That no two words share a hash
   is checked over all distinct words (else another seed is taken).
2. Mappers count words and pairs of words in hash buckets, as arrays; the arrays
   are summed in a tree.  A phrase cannot reach the least count where its bucket,
   or that of a part, does not.  Runs of 3 and 4 words whose pairs pass are then
   counted in the same way.  What passes is Apriori-safe: no phrase that reaches
   the least count is lost.
3. The distinct phrases that pass are the candidates.  Each shard of them gets a
   minimal perfect hash and its stored keys.
4. Mappers look occurrences up, verify them against the stored key, and count by
   slot with ``bincount``; a tree sums the arrays.  Counts are exact.
5. Parts of phrases are looked up the same way, and their counts read by slot.

A task holds one block of candidates, ``most_keys`` at most; more of them are
taken in several passes over the runs.  The bucket tables have about half as
many buckets as there are words, ``most_bits`` at most (then fewer phrases are
ruled out, and the passes are more; the result stays the same).

Defined results: a null text counts as empty, a null lang as ``und``; repeated
rows count each time; ids are not read, so null or repeated ones are harmless;
other columns are not read, so clashing names are harmless; an empty table, or one
without a phrase of the least count, gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, stored, table
from .mph import Mph, build, mixed

LONGEST, CHUNK, FAN_IN, SHARD_KEYS = 4, 1 << 16, 64, 32_768
#: Rows that a task gives at once.
AT_ONCE = 1 << 16
KEY = [f"k{i}" for i in range(1, LONGEST + 1)]
#: Bytes that end a piece become ".", a tab becomes a space; "." is in no word, so it can stand for the end of a piece.
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
_STEP, _RUN = 1 << 20, 1 << 19
_CUT = re.compile(rb"[ .]")


class Words(dict):
    """Word to hash for one language; new words are noted."""

    def __init__(self, lang: str, seed: int):
        super().__init__({b".": 0})
        self.lang, self.prefix, self.seed, self.new = lang, lang.encode() + b"\0", seed, []

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(self.prefix + word, self.seed) or 1
        self.new.append((word, value))
        return value


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words and ends of pieces (b"."), a slice of a long text at a time."""
    text, at = text.lower().translate(_MARKS), 0  # bytes.lower() changes A-Z only
    while at < len(text):
        stop = _CUT.search(text, at + _STEP)
        end = stop.start() if stop else len(text)
        yield text[at:end].replace(b".", b" . ").split()
        at = end


def _encode(seed: int, most_words: int = 500_000) -> Callable:
    schema = pa.schema([("lang", pa.string()), ("words", pa.int64()), ("run", pa.binary()), ("word", pa.string()), ("hash", pa.int64())])

    def rows(lang: str, arrays: list[np.ndarray]) -> pa.RecordBatch:
        run = np.concatenate(arrays)
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([np.count_nonzero(run)]), pa.array([zstandard.compress(run.tobytes(), 1)], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], schema=schema)

    def found(known: Words) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(known.new), AT_ONCE):
            new = known.new[at : at + AT_ONCE]
            hashes = np.array([h for _, h in new], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([known.lang] * len(new), pa.string()), pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.binary()), pa.array([w for w, _ in new], pa.binary()).cast(pa.string()), pa.array(hashes)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[str, Words] = {}
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                lang = lang.as_py()
                known = vocabulary.setdefault(lang, Words(lang, seed))
                mine = held.setdefault(lang, [])
                for part in tokens(text.as_buffer().to_pybytes()):
                    mine.append(np.fromiter(map(known.__getitem__, part), np.uint64, len(part)))
                    if sum(map(len, mine)) >= _RUN:  # a run is cut at the end of a piece only
                        whole = np.concatenate(mine)
                        ends = np.flatnonzero(whole == 0)
                        if len(ends):
                            yield rows(lang, [whole[: ends[-1] + 1]])
                            whole = whole[ends[-1] + 1 :]
                        mine[:] = [whole]
                mine.append(np.zeros(1, np.uint64))
                if len(known) > most_words:
                    yield from found(known)
                    vocabulary.pop(lang)
        for lang, mine in held.items():
            yield rows(lang, mine)
        for known in vocabulary.values():
            yield from found(known)

    return run


def encoded(docs: DataFrame, lang_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, words, run) and the distinct (lang, word, hash)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    for seed in range(1, 9):
        both = stored(texts.mapInArrow(_encode(seed), "lang string, words long, run binary, word string, hash long"))
        words = cut(both.filter("word IS NOT NULL").select("lang", "word", "hash").distinct())
        if not words.groupBy("hash").count().filter("count > 1").limit(1).count():
            return both.filter("word IS NULL").select("lang", "words", "run"), words
        drop_cut(words)
    raise RuntimeError("words share a hash under every seed")


# --- phrases of a run


def unpacked(cell: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(cell.as_buffer()), np.uint64)


def hashes_of(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of phrases given by their words' columns (0: no word)."""
    h, g = np.zeros(len(columns[0]), np.uint64), np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        used = c != 0
        h = np.where(used, mixed(h) * np.uint64(0xD6E8FEB86659FD93) + c, h)
        g = np.where(used, (g ^ c) * np.uint64(0xFF51AFD7ED558CCD) + (g >> np.uint64(31)), g)
    return mixed(h), mixed(g)


def phrases(run: np.ndarray, bits: int, passing: list[np.ndarray], first: int = 1, last: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, hash) of a run's phrases of these lengths, where they and all their parts pass.

    passing: a bit for each bucket, of words and pairs, then of longer phrases; lengths beyond those given are not tested themselves.
    """
    alive, h = run != 0, np.zeros(len(run), np.uint64)
    for k in range(1, last + 1):
        n = len(run) - k + 1
        if n <= 0:
            return
        if k > 1:
            alive = alive[:-1] & alive[1:]  # first and last part
        starts = np.flatnonzero(alive)
        h[starts] = mixed(h[starts]) * np.uint64(0xD6E8FEB86659FD93) + run[starts + (k - 1)]
        value = mixed(h[starts])
        if (k - 1) // 2 < len(passing):
            good = passes(passing[(k - 1) // 2], value, bits)
            starts, value = starts[good], value[good]
            alive = np.zeros(n, bool)
            alive[starts] = True
        if not len(starts):
            return
        if k >= first:
            yield k, starts, value


def passes(table: np.ndarray, value: np.ndarray, bits: int) -> np.ndarray:
    at = value >> np.uint64(64 - bits)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def columns_of(run: np.ndarray, k: int, starts: np.ndarray) -> list[np.ndarray]:
    return [run[starts + i] if i < k else np.zeros(len(starts), np.uint64) for i in range(LONGEST)]


# --- arrays that are summed in a tree

SUMS = "part long, chunk long, at binary, n binary, width int"


def _packed(part: int, index: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``SUMS`` for sorted distinct indexes: the places within chunks, and counts as narrow as they allow."""
    chunk = index // CHUNK
    first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
    cells: list[list] = [[], [], [], [], []]
    for a, b in zip(first, [*first[1:], len(index)], strict=True):
        width = next(w for w in (1, 2, 4, 8) if w == 8 or counts[a:b].max() < 1 << (8 * w))
        for cell, x in zip(cells, (part, int(chunk[a]), (index[a:b] % CHUNK).astype(np.uint16).tobytes(), counts[a:b].astype(f"u{width}").tobytes(), width), strict=True):
            cell.append(x)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], ["part", "chunk", "at", "n", "width"])


def _added(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of one chunk's rows together."""
    total = np.zeros(CHUNK, np.int64)
    for at, n, width in zip(rows.column("at"), rows.column("n"), rows.column("width"), strict=True):
        total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), f"u{width.as_py()}").astype(np.int64)
    places = np.flatnonzero(total)
    return places, total[places]


def _sum_group(key: tuple, rows: pa.Table) -> pa.Table:
    places, counts = _added(rows)
    return pa.Table.from_batches(_packed(key[0].as_py(), key[1].as_py() * CHUNK + places, counts))


def tree_sum(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of ``SUMS``, one for each chunk: ``FAN_IN`` parts meet in a sum, until one is left."""
    while True:
        parts = -(-parts // FAN_IN)
        rows = rows.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part", "chunk").applyInArrow(_sum_group, SUMS)
        if parts <= 1:
            return rows


def _bucket_counts(bits: int, passing: list[np.ndarray], most: int = 2_000_000) -> Callable:
    """Counts of the two lengths after those that ``passing`` has."""
    first = 2 * len(passing) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            for cell in batch.column(0):
                for _, _, h in phrases(unpacked(cell), bits, passing, first, first + 1):
                    held.append((h >> np.uint64(64 - bits)).astype(np.uint32))
                    n += len(h)
                if n >= most:
                    yield from _packed(part, *np.unique(np.concatenate(held), return_counts=True))
                    held, n = [], 0
        if n:
            yield from _packed(part, *np.unique(np.concatenate(held), return_counts=True))

    return run


def passing_buckets(runs: DataFrame, bits: int, least: int, passing: list[np.ndarray]) -> np.ndarray:
    """A bit for each of 2 ** bits buckets: whether it holds the least count."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                places, counts = _added(pa.Table.from_batches([batch.slice(i, 1)]))
                flags = np.zeros(CHUNK, np.uint8)
                flags[places[counts >= least]] = 1
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("chunk")[i].as_py()]), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["chunk", "flags"])

    summed = tree_sum(runs.select("run").mapInArrow(_bucket_counts(bits, passing), SUMS), runs.rdd.getNumPartitions())
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in summed.mapInArrow(keep, "chunk long, flags binary").collect():  # 2 ** bits bits in all
        out[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["flags"], np.uint8)
    return out


# --- candidates, their perfect hash, exact counts


def _distinct_candidates(bits: int, passing: list[np.ndarray]) -> Callable:
    """Phrases of two words and more, each once a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                words = unpacked(cell)
                for k, starts, h in phrases(words, bits, passing, 2):
                    order = np.argsort(h)
                    h, starts = h[order], starts[order]
                    new = np.ones(len(h), bool)
                    new[1:] = h[1:] != h[:-1]
                    for i in range(k):  # of equal hashes all phrases that differ from the one before stay
                        new[1:] |= words[starts[1:] + i] != words[starts[:-1] + i]
                    starts = starts[new]
                    for i in range(0, len(starts), AT_ONCE):
                        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns_of(words, k, starts[i : i + AT_ONCE])], KEY)

    return run


def _single_words(bits: int, passing: np.ndarray) -> Callable:
    """The words that pass, as phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column(0).to_numpy().view(np.uint64)
            word = word[passes(passing, mixed(mixed(np.zeros(len(word), np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + word), bits)]
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *[pa.array(np.zeros(len(word), np.int64))] * (LONGEST - 1)], KEY)

    return run


def _with_shard(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, _ = hashes_of([batch.column(k).to_numpy().view(np.uint64) for k in KEY])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((h % np.uint64(shards)).astype(np.int64))], [*KEY, "shard"])

    return run


def _build_shard(rows: pa.Table) -> pa.Table:
    columns = [rows.column(k).to_numpy().view(np.uint64) for k in KEY]
    h, g = hashes_of(columns)
    sizes, words, order = build(h, g)
    keys = np.stack([c[order] for c in columns], axis=1)
    cells = [rows.column("shard")[0].as_py(), len(h), sizes, words.tobytes(), keys.tobytes()]
    return pa.table([[c] for c in cells], schema=pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("keys", pa.binary())]))


class Block:
    """Consecutive shards of candidates: perfect hash, stored keys, and, once known, counts by slot. ``base`` is its first slot among all."""

    def __init__(self, rows: list, shards: int, base: int):
        first = rows[0]["shard"]
        by = {r["shard"]: r for r in rows}
        every = [by.get(s) for s in range(first, rows[-1]["shard"] + 1)]  # a shard may be empty
        self.mph = Mph(first, shards, [r["sizes"] if r else [] for r in every], [np.frombuffer(r["words"], np.uint64) for r in every if r])
        self.keys = np.concatenate([np.frombuffer(r["keys"], np.uint64).reshape(-1, LONGEST) for r in every if r])
        self.base, self.counts = base, np.zeros(0, np.int64)

    def slots(self, columns: list[np.ndarray]) -> np.ndarray:
        """Slots of phrases, -1 where the stored key is another."""
        slot = self.mph.slots(*hashes_of(columns))
        at = np.flatnonzero(slot >= 0)
        same = np.ones(len(at), bool)
        for i, c in enumerate(columns):
            same &= self.keys[slot[at], i] == c[at]
        out = np.full(len(slot), -1, np.int64)
        out[at[same]] = slot[at[same]]
        return out


def _slot_counts(block: Block, bits: int, passing: list[np.ndarray], at_once: int = 1 << 18) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.keys), np.int64)
        for batch in batches:
            for cell in batch.column(0):
                words = unpacked(cell)
                for k, starts, _ in phrases(words, bits, passing):
                    for i in range(0, len(starts), at_once):
                        slot = block.slots(columns_of(words, k, starts[i : i + at_once]))
                        total += np.bincount(slot[slot >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        if len(some):
            yield from _packed(TaskContext.get().partitionId(), some, total[some])

    return run


def _frequent(block: Block, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.concatenate([np.zeros(0, np.int64), *(batch.column("chunk")[i].as_py() * CHUNK + np.frombuffer(batch.column("at")[i].as_buffer(), np.uint16).astype(np.int64) for i in range(batch.num_rows))])
            a = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(batch.column("n")[i].as_buffer(), f"u{batch.column('width')[i].as_py()}").astype(np.int64) for i in range(batch.num_rows))])
            slot, a = slot[a >= least], a[a >= least]
            yield pa.RecordBatch.from_arrays([pa.array(block.base + slot), pa.array(a), *(pa.array(block.keys[slot, i].view(np.int64)) for i in range(LONGEST))], ["slot", "a", *KEY])

    return run


def _read_parts(block: Block) -> Callable:
    """For each phrase and each cut the counts of both parts that this block holds (side 0, 1), and for each shorter phrase within it that this block holds the phrase's own count (side 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, a = batch.column("slot").to_numpy(), batch.column("a").to_numpy()
            keys = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in KEY], axis=1)
            length = (keys != 0).sum(axis=1)
            none = np.zeros(len(keys), np.uint64)
            for k in range(2, LONGEST + 1):
                mine = np.flatnonzero(length == k)
                spans = {(0, c) for c in range(1, k)} | {(c, k) for c in range(1, k)} | {(i, j) for i in range(k) for j in range(i + 2, k + 1) if j - i < k}
                for i, j in sorted(spans) if len(mine) else ():
                    part = block.slots([keys[mine, i + x] if i + x < j else none[mine] for x in range(LONGEST)])
                    found = part >= 0
                    facts = []
                    if i == 0 or j == k:
                        facts.append((slot[mine[found]], j if i == 0 else i, 0 if i == 0 else 1, block.counts[part[found]]))
                    if j - i >= 2:
                        facts.append((block.base + part[found], 0, 2, a[mine[found]]))
                    for s, at, side, n in facts:
                        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), at, np.int32)), pa.array(np.full(len(s), side, np.int32)), pa.array(n)], ["slot", "cut", "side", "n"])

    return run


def score(a: Column | str, l: Column | str, r: Column | str) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)), exact for any long."""
    return F.expr(f"CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(19,0))) DIV (CAST({l} AS DECIMAL(19,0)) + CAST({r} AS DECIMAL(19,0))) AS BIGINT)")


def _blocks(shards: DataFrame, n_shards: int, most_keys: int) -> Iterator[Block]:
    """Blocks of at most ``most_keys`` candidates (a shard at least), one at a time."""
    sizes = sorted((r["shard"], r["n"]) for r in shards.select("shard", "n").collect())
    at = base = 0
    while at < len(sizes):
        end, n = at + 1, sizes[at][1]
        while end < len(sizes) and n + sizes[end][1] <= most_keys:
            n += sizes[end][1]
            end += 1
        yield Block(shards.filter(F.col("shard").between(sizes[at][0], sizes[end - 1][0])).orderBy("shard").collect(), n_shards, base)
        at, base = end, base + n


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, most: int = 2000, covered: int = 80, most_keys: int = 2_000_000, most_bits: int = 28) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase that stands inside a longer one with at least ``covered`` percent of its count is left out.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    runs, words = encoded(docs, lang_col, text_col)
    totals = cut(runs.groupBy("lang").agg(F.sum("words").alias("n")))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    bits = int(min(most_bits, max(20, np.ceil(np.log2(max(n_words, 1))) - 1)))
    passing = [passing_buckets(runs, bits, least, [])]
    if not passing[0].any():
        return empty
    passing.append(passing_buckets(runs, bits, least, passing))
    n_shards = -(-int(sum(np.bitwise_count(p).sum() for p in passing)) // SHARD_KEYS)
    longs = lambda *names: ", ".join(f"{c} long" for c in names)
    seen = runs.select("run").mapInArrow(_distinct_candidates(bits, passing), longs(*KEY)).distinct()
    seen = seen.unionByName(words.select("hash").mapInArrow(_single_words(bits, passing[0]), longs(*KEY)))
    shards = cut(seen.mapInArrow(_with_shard(n_shards), longs(*KEY, "shard")).groupBy("shard").applyInArrow(_build_shard, "shard long, n long, sizes array<long>, words binary, keys binary"))
    tables, blocks = [], []
    for block in _blocks(shards, n_shards, most_keys):
        summed = cut(tree_sum(runs.select("run").mapInArrow(_slot_counts(block, bits, passing), SUMS), runs.rdd.getNumPartitions()))
        tables.append(cut(summed.mapInArrow(_frequent(block, least), longs("slot", "a", *KEY))))
        blocks.append(summed)
        block = None  # the driver holds one at a time
    frequent = tables[0]
    for more in tables[1:]:
        frequent = frequent.unionByName(more)
    facts = None
    for block, summed in zip(_blocks(shards, n_shards, most_keys), blocks, strict=True):
        block.counts = np.zeros(len(block.keys), np.int64)
        for r in summed.collect():  # most_keys counts
            block.counts[r["chunk"] * CHUNK + np.frombuffer(r["at"], np.uint16).astype(np.int64)] = np.frombuffer(r["n"], f"u{r['width']}").astype(np.int64)
        read = frequent.filter("k2 <> 0").mapInArrow(_read_parts(block), "slot long, cut int, side int, n long")
        read = cut(read.groupBy("slot", "cut", "side").agg(F.max("n").alias("n")))
        facts = read if facts is None else facts.unionByName(read)
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("n")))
    cuts = facts.filter("side < 2").groupBy("slot", "cut").agg(side(0).alias("l"), side(1).alias("r"))
    longer = facts.filter("side = 2").groupBy("slot").agg(F.max("n").alias("longer"))
    scored = frequent.filter("k2 <> 0").join(cuts, "slot").withColumn("score", score("a", "l", "r"))
    best = scored.groupBy("slot", "a", *KEY).agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "cut")).alias("b")).select("slot", "a", *KEY, "b.*")
    percent = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(3,0)")
    best = best.join(longer, "slot", "left").filter(F.col("longer").isNull() | (percent("longer", 100) < percent("a", covered)))
    known = cut(words.join(frequent.filter("k2 = 0").select(F.col("k1").alias("hash")), "hash"))
    best = cut(best.join(known.select(F.col("hash").alias("k1"), "lang"), "k1"))
    order = [F.desc("score"), F.desc("a")]
    for keys in (["lang", F.pmod(F.col("slot"), F.lit(64))], ["lang"]):  # in parts first; ties with the last one stay
        best = best.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= most).drop("place")
    for i, k in enumerate(KEY):
        best = best.join(known.select(F.col("hash").alias(k), F.col("word").alias(f"w{i}")), k, "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *(f"w{i}" for i in range(LONGEST)))).join(totals, "lang")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, d, unnest(ps) AS s, unnest(range(len(ps))) AS p FROM t),
q AS (SELECT lang, d, p, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: ws[i : i + k - 1])))) AS k FROM q),
f AS (SELECT lang, k, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE len(k) = 1 GROUP BY lang),
c AS (SELECT lang, k, a FROM f WHERE a >= 30),
x AS (SELECT lang, k, a, unnest(range(1, len(k))) AS cut FROM c WHERE len(k) > 1),
y AS (SELECT x.lang, x.k, x.a, x.cut, l.a AS l, r.a AS r, CAST(2000000 AS HUGEINT) * x.a // (l.a + r.a) AS score
      FROM x JOIN c l ON l.lang = x.lang AND l.k = x.k[1 : x.cut] JOIN c r ON r.lang = x.lang AND r.k = x.k[x.cut + 1 : len(x.k)]),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, k ORDER BY score, cut) = 1),
i AS (SELECT lang, a AS b, unnest([k[1 : 2], k[2 : 3], k[3 : 4], k[1 : 3], k[2 : 4]]) AS k, len(k) AS m FROM c WHERE len(k) > 2),
m AS (SELECT lang, k, max(b) AS longer FROM i WHERE len(k) < m AND len(k) > 1 GROUP BY ALL),
o AS (SELECT z.lang, array_to_string(z.k, ' ') AS phrase, z.a, z.l, z.r, n.n, z.score
      FROM z JOIN n ON n.lang = z.lang LEFT JOIN m ON m.lang = z.lang AND m.k = z.k WHERE m.longer IS NULL OR 100 * m.longer < 80 * z.a)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000
"""
