"""Benchmark decontamination: CGK random-walk embedding and bit-sampling LSH, exact edit verification.

Texts are sequences of words (runs of word characters, lower-cased).  An item of
n words leaks into a document where some passage is within floor((1 - similarity)
* n) word insertions, deletions and substitutions of the whole item.

The CGK embedding walks a sequence with one random bit per (step, word): each
step emits the current word and advances by the bit, so that edit distance k
becomes a Hamming distance of O(k**2) with good odds, independent of position.
Benchmark items and item-sized windows of the documents walk alike; each walk
gives ``samples`` codes, each of some embedded coordinates (8 hashed bits a
coordinate).  Equal codes make a candidate, which word-level edit distance then
verifies exactly around the window.  For each class of item lengths the number of
coordinates (4 at most) and of walks (``most_walks`` at most) is what finds
``target_recall`` of trial copies, made of the items themselves with as many
random edits as are allowed; ``BenchmarkIndex.recalls`` has what was reached.

Windows are those that can match at all.  An item with k edits allowed is cut into
k + 1 pieces, and since an edit touches one piece at most, every passage within k
edits holds one piece unchanged, at most k words away from its place in the item:
windows begin within k words of where a piece (its first SEED_WORDS words) puts the
item, and have at least n - k words of the benchmark's vocabulary.  This drops no
match, and leaves few windows to walk however large the benchmark.

What the walks miss is not found: recall is what the trials of a class reach
(exact copies always agree, with every walk).  ``exact=True`` also verifies the
windows that no candidate covers, so that recall is 1 at every length.

Items are taken in blocks of at most ``block_chars`` characters (at least one
item), each block sent to all tasks; the documents stay where they are, nothing
is shuffled, and hot passages cost no more than others.

Defined results: null or wordless texts and items match nothing; an item of
fewer words than 1 / (1 - similarity) matches exactly only; repeated rows give
repeated results, repeated items count once; of several places of an item in one text
the one of least distance, then the first, is given; other columns are not read,
whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = re.compile(r"\w+")
BATCH_WORDS = 1 << 20
#: Of a longer piece the first words are looked up: they are unchanged where the piece is.
SEED_WORDS = 8
#: Seed occurrences times items that are held at once, if they are not in one document.
HELD_HITS = 1 << 22
#: Copies with edits that a class of lengths is tried with.
TRIALS = 200
MARK_BITS = 20
ONE = np.uint64(1)
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, item_id long, distance int, similarity double, word_start int, word_end int, char_start int, char_end int"


def walk_codes(words: np.ndarray, starts: np.ndarray, places: list[np.ndarray], seed: np.ndarray) -> list[np.ndarray]:
    """Codes of the CGK walks from the starts: one array for each set of sampled steps.

    words: int ids with enough zeros at the end, or these as unsigned numbers greater by one; seed: one odd 64-bit number a step.
    """
    words = words if words.dtype == np.uint64 else words.astype(np.uint64) + ONE
    at, codes = starts.astype(np.int64), [np.zeros(len(starts), np.uint64) for _ in places]
    last = max(int(p[-1]) for p in places)
    sampled = [set(p.tolist()) for p in places]
    for step in range(last + 1):
        symbol = words[at]
        for code, steps in zip(codes, sampled, strict=True):
            if step in steps:
                code <<= np.uint64(8)
                code |= (symbol * MULTIPLY) >> np.uint64(56)
        at += ((symbol * seed[step]) >> np.uint64(63)).view(np.int64)
    return codes


def walk_symbols(words: np.ndarray, starts: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The embedded coordinates (8 bits each) of CGK walks of len(seed) steps: one row a step."""
    words, at = words.astype(np.uint64) + ONE, starts.astype(np.int64)
    out = np.zeros((len(seed), len(starts)), np.uint8)
    for step, odd in enumerate(seed):
        symbol = words[at]
        out[step] = (symbol * MULTIPLY) >> np.uint64(56)
        at += ((symbol * odd) >> np.uint64(63)).view(np.int64)
    return out


def edited(words: np.ndarray, edits: int, vocabulary: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many random insertions, deletions and substitutions."""
    out = words.tolist()
    for kind in rng.integers(3, size=edits):
        at, word = int(rng.integers(len(out) + 1)), int(rng.integers(1, vocabulary + 1))
        out[at : at + (kind > 0)] = [word] if kind < 2 else []
    return np.array(out, np.int64)


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of item to any part of text, and that part's start and end."""
    n = len(text)
    ramp = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), ramp.copy()
    for i, w in enumerate(item, 1):
        swap = cost[:-1] + (text != w)
        drop = cost[1:] + 1
        own = np.concatenate(([i], np.minimum(swap, drop)))
        origin = np.concatenate(([0], np.where(swap <= drop, start[:-1], start[1:])))
        # insertions of text words: a running minimum of own - position
        key = (own - ramp) * (n + 1) + (n - ramp)
        low = np.minimum.accumulate(key)
        at = n - low % (n + 1)
        cost, start = own[at] + (ramp - at), origin[at]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class BenchmarkIndex:
    """Codes of a block of items, by length class."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, target_recall: float = 0.99, most_walks: int = 24, samples: int = 6, seed: int = 11, exact: bool = False):
        self.vocabulary: dict[str, int] = {}
        self.items, lengths, self.exact = [], [], exact
        for item_id, text in items:
            words = WORD.findall((text or "").lower())
            if words:
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)))
                lengths.append(len(words))
        self.allowed = np.array([math.floor((1 - similarity) * n + 1e-9) for n in lengths], np.int64)
        self.distinct = [frozenset(words.tolist()) for _, words in self.items]
        self.longest = max(lengths, default=0)
        self.classes, self.class_of, self.recalls = [], np.zeros(len(lengths), np.int64), {}
        rng = np.random.default_rng(seed)
        low = 1
        while low <= self.longest:
            high = max(low, int(low * 1.15))
            members = [i for i, n in enumerate(lengths) if low <= n <= high]
            if members:
                self.class_of[members] = len(self.classes)
                self.classes.append(self._class(members, lengths, rng, target_recall, most_walks, samples))
                self.recalls[low, high] = self.classes[-1]["recall"]
            low = high + 1
        self.mixers = rng.integers(1, 1 << 63, size=SEED_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.own = [np.unique(words) for _, words in self.items]
        self.seeds = self._seeds(lengths)
        self.mark = np.zeros(len(self.vocabulary) + 1, bool)  # of use in verify, all False between calls

    def _seeds(self, lengths) -> dict[int, tuple[np.ndarray, ...]]:
        """For each seed length: sorted hashes, where each one's places begin, and the places as item and offset."""
        held: dict[int, list[tuple[int, int, int]]] = {}
        for i, n in enumerate(lengths):
            words = self.items[i][1].astype(np.uint64)
            bounds = [n * j // min(self.allowed[i] + 1, n) for j in range(min(self.allowed[i] + 1, n) + 1)]
            for a, b in itertools.pairwise(bounds):
                size = min(b - a, SEED_WORDS)
                held.setdefault(size, []).append((int((words[a : a + size] * self.mixers[:size]).sum()), i, a))
        out = {}
        for size, rows in held.items():
            rows.sort()
            keys, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
            marks = np.zeros(1 << MARK_BITS, bool)  # most words begin no piece: one look-up tells
            marks[(keys * MULTIPLY) >> np.uint64(64 - MARK_BITS)] = True
            out[size] = keys, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), marks
        return out

    def seed_hits(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Occurrences of seeds: the place in ids, and the range of the seed's places in the table of its length."""
        found = [[], [], [], []]
        ids = np.append(ids, np.zeros(SEED_WORDS, np.int64))
        at = np.flatnonzero(ids > 0)
        code = np.zeros(len(at), np.uint64)
        for size in range(1, max(self.seeds, default=0) + 1):
            word = ids[at + size - 1]
            known = word > 0
            at, code = at[known], code[known] + word[known].astype(np.uint64) * self.mixers[size - 1]
            if size in self.seeds:
                keys, first, _, _, marks = self.seeds[size]
                maybe = np.flatnonzero(marks[(code * MULTIPLY) >> np.uint64(64 - MARK_BITS)])
                k = np.minimum(np.searchsorted(keys, code[maybe]), len(keys) - 1)
                hit = keys[k] == code[maybe]
                k = k[hit]
                for column, part in zip(found, (at[maybe[hit]], np.full(len(k), size), first[k], first[k + 1]), strict=True):
                    column.append(part)
        place, *rest = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)
        order = np.argsort(place, kind="stable")
        return place[order], *(c[order] for c in rest)

    def seeded(self, ids: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows (document, item, start) by seeds, a document's together: starts are within the item's edits of the true one."""
        place, size, first, last = self.seed_hits(ids)
        doc = np.searchsorted(begins, place, "right") - 1
        total = np.concatenate(([0], np.cumsum(last - first)))
        a = 0
        while a < len(place):
            b = max(a + 1, int(np.searchsorted(total, total[a] + HELD_HITS, "right")) - 1)
            b = int(np.searchsorted(doc, doc[b - 1], "right")) if b < len(place) else len(place)
            docs, items, starts = [], [], []
            for s, (_, _, item, offset, _) in self.seeds.items():
                rows = a + np.flatnonzero(size[a:b] == s)
                many = last[rows] - first[rows]
                entry = np.arange(many.sum()) + np.repeat(first[rows] - np.cumsum(many) + many, many)
                d = np.repeat(doc[rows], many)
                docs.append(d)
                items.append(item[entry])
                starts.append(np.maximum(np.repeat(place[rows], many) - offset[entry], begins[d]))
            yield np.concatenate(docs), np.concatenate(items), np.concatenate(starts)
            a = b

    def _class(self, members, lengths, rng, target_recall, most_walks, samples) -> dict:
        shortest, edits = min(lengths[i] for i in members), max(self.allowed[i] for i in members)
        steps, longest = max(1, int(1.4 * shortest)), max(lengths[i] for i in members)
        seeds = [rng.integers(1, 1 << 63, size=steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(most_walks)]
        trials = [members[int(i)] for i in rng.integers(len(members), size=TRIALS)]
        pairs = [x for i in trials for x in (self.items[i][1], edited(self.items[i][1], int(self.allowed[i]), len(self.vocabulary), rng))]
        # what follows an item in a document is other text
        laid = np.concatenate([x for words in pairs for x in (words, rng.integers(1, len(self.vocabulary) + 1, size=steps + 2))])
        at = np.cumsum([0] + [len(words) + steps + 2 for words in pairs[:-1]])
        agree: list[np.ndarray] = []
        for places in range(min(4, steps), 0, -1):
            sets, found = [], np.zeros(TRIALS, bool)
            for w in range(most_walks):
                if w == len(agree):
                    symbols = walk_symbols(laid, at, seeds[w])
                    agree.append(symbols[:, ::2] == symbols[:, 1::2])
                # each step draws its own share of places, so that codes see all of the item
                sets.append([np.sort(rng.choice(steps, size=places, replace=False)) for _ in range(samples)])
                for chosen in sets[-1]:
                    found |= agree[w][chosen].all(axis=0)
                if found.mean() >= target_recall:
                    break
            if found.mean() >= target_recall:
                break
        pad = steps + 2
        words = np.concatenate([np.concatenate((self.items[i][1], np.zeros(pad, np.int64))) for i in members])
        starts = np.cumsum([0] + [lengths[i] + pad for i in members[:-1]])
        tables = []
        for chosen, seed in zip(sets, seeds, strict=False):
            codes = walk_codes(words, starts, chosen, seed)
            tables.append([])
            for code in codes:
                order = np.argsort(code, kind="stable")
                tables[-1].append((code[order], np.array(members)[order]))
        return {"need": max(1, shortest - edits), "size": shortest, "edits": int(edits), "sets": sets, "seeds": seeds[: len(sets)], "tables": tables, "recall": float(found.mean()), "longest": longest}

    def walked(self, ids: np.ndarray, items: np.ndarray, starts: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Candidates (start, item), distinct and sorted, of the walks over the windows that the seeds allow; ids have zeros at the end."""
        found = [np.zeros(0, np.int64)]
        group, words = self.class_of[items], ids.astype(np.uint64) + ONE
        for number in np.unique(group).tolist():
            c = self.classes[number]
            near = np.unique(starts[group == number])
            near = np.unique((near[:, None] + np.arange(-c["edits"], c["edits"] + 1)).ravel())
            near = near[(near >= 0) & (near < len(ids))]
            near = near[known[np.minimum(near + c["size"], len(ids))] - known[near] >= c["need"]]
            for chosen, seed, tables in zip(c["sets"], c["seeds"], c["tables"], strict=True):
                if not len(near):
                    break
                for code, (keys, members) in zip(walk_codes(words, near, chosen, seed), tables, strict=True):
                    first, last = np.searchsorted(keys, code), np.searchsorted(keys, code, "right")
                    many = last - first
                    entry = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
                    found.append(np.unique(np.repeat(near, many) * len(self.items) + members[entry]))
        return np.column_stack(np.divmod(np.unique(np.concatenate(found)), len(self.items)))

    def verify(self, ids: np.ndarray, begin: int, stop: int, starts: np.ndarray, i: int, wide: int = 0) -> tuple[tuple[int, int, int] | None, int, int]:
        """(distance, start, end) of the best place of item i near the sorted starts, within its document; and the range that was seen. wide: words more at both ends."""
        item, k = self.items[i][1], int(self.allowed[i])
        same = starts[(starts >= begin) & (starts + len(item) <= stop)]
        same = same[ids[same] == item[0]]
        for s in same.tolist():
            if np.array_equal(ids[s : s + len(item)], item):
                return (0, s, s + len(item)), 0, 0  # an earlier one may not be among the starts
        low, high = np.maximum(begin, starts - k - wide), np.minimum(stop, starts + len(item) + 2 * k + wide)
        a = int(low[0])
        part = ids[a : int(high[-1])]
        self.mark[self.own[i]] = True
        shared = np.concatenate(([0], np.cumsum(self.mark[part])))
        self.mark[self.own[i]] = False
        fit = shared[high - a] - shared[low - a] >= len(item) - k  # an edit removes one word at most
        best = None
        for lo, hi in _joined(low[fit], high[fit]):
            if len(self.distinct[i].intersection(ids[lo:hi].tolist())) < len(self.distinct[i]) - k:
                continue
            distance, s, e = infix_distance(item, ids[lo:hi])
            if distance <= k and (best is None or (distance, lo + s, lo + e) < best):
                best = distance, lo + s, lo + e
        return best, a, int(high[-1])


def _joined(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Overlapping windows (both ends ascending) made one."""
    if len(low):
        new = np.flatnonzero(low[1:] > high[:-1]) + 1
        yield from zip(low[np.append(0, new)].tolist(), high[np.append(new - 1, len(low) - 1)].tolist(), strict=True)


def _match_batch(index: BenchmarkIndex, rows: list[tuple[int, str]]) -> Iterator[tuple]:
    gap = np.zeros(2 * index.longest + int(1.4 * index.longest) + 4, np.int64)
    parts, spans, at = [], [], 0
    for doc_id, text in rows:
        words = WORD.findall(text.lower())
        ids = np.fromiter(map(index.vocabulary.get, words, itertools.repeat(0)), np.int64, len(words))
        spans.append((at, at + len(ids), doc_id, text))
        parts += [ids, gap]
        at += len(ids) + len(gap)
    ids = np.concatenate(parts)
    begins, ends = (np.array([s[i] for s in spans]) for i in (0, 1))
    known = np.concatenate(([0], np.cumsum(ids > 0)))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def look(docs: np.ndarray, items: np.ndarray, starts: np.ndarray, seen: dict, wide: bool) -> None:
        order = np.lexsort((starts, items, docs))
        docs, items, starts = docs[order], items[order], starts[order]
        firsts = np.flatnonzero(np.diff(docs, prepend=-1) | np.diff(items, prepend=-1))
        for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(docs)], strict=False):
            n, i = int(docs[a]), int(items[a])
            near, k, (begin, stop, _, _) = starts[a:b], int(index.allowed[i]), spans[n]
            if (n, i) in seen:
                lo, hi = seen[n, i]
                near = near[(np.maximum(begin, near - k) < lo) | (np.minimum(stop, near + len(index.items[i][1]) + 2 * k) > hi)]
            if len(near):
                got, lo, hi = index.verify(ids, begin, stop, near, i, k if wide else 0)
                if wide and (len(near) == 1 or near[-1] - near[0] <= k):  # else the range has holes
                    seen[n, i] = lo, hi
                if got and got < best.get((n, i), (1 << 60,)):
                    best[n, i] = got

    for docs, items, starts in index.seeded(ids, begins):
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        candidates = index.walked(ids, items, starts, known)
        owner = np.searchsorted(begins, candidates[:, 0], "right") - 1
        within = candidates[:, 0] < ends[owner]
        look(owner[within], candidates[within, 1], candidates[within, 0], seen, True)
        if index.exact:
            look(docs, items, starts, seen, False)  # what the walks have missed
    last = -1
    for (n, i), (distance, s, e) in sorted(best.items()):
        begin, _, doc_id, text = spans[n]
        item_id, item = index.items[i]
        if n != last:
            last, low = n, text.lower()
            places = [m.span() for m in WORD.finditer(low)]
        a, b = s - begin, e - begin
        span = places[a][0] if a < len(places) else 0, places[b - 1][1] if b > a else 0
        if len(low) != len(text):  # some letters grow when lowered
            grown = np.cumsum([len(c.lower()) for c in text])
            span = int(np.searchsorted(grown, span[0], "right")), int(np.searchsorted(grown, span[1], "left")) + (span[1] > 0)
        yield doc_id, item_id, distance, 1 - distance / len(item), a, b, *span


def _matcher(index: BenchmarkIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            out, rows, held = [], [], 0
            texts, ids = batch.column("text"), batch.column("id").to_pylist()
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if text:
                    rows.append((ids[k], text))
                    held += len(text)
                if rows and (held >= 6 * BATCH_WORDS or k == batch.num_rows - 1):
                    out += _match_batch(index, rows)
                    rows, held = [], 0
            if rows:
                out += _match_batch(index, rows)
            schema = schema or pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64()), ("word_start", pa.int32()), ("word_end", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32())])
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _keeper(index: BenchmarkIndex, at: int):
    """Drops the rows whose text, column number ``at``, holds a passage of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows, held = np.ones(batch.num_rows, bool), [], 0
            for k, text in enumerate(batch.column(at)):
                if text.is_valid:
                    rows.append((k, text.as_py()))
                    held += len(rows[-1][1])
                if rows and (held >= 6 * BATCH_WORDS or k == batch.num_rows - 1):
                    keep[[hit[0] for hit in _match_batch(index, rows)]] = False
                    rows, held = [], 0
            yield batch.filter(pa.array(keep))

    return run


def indexes(items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, target_recall: float = 0.99, most_walks: int = 24, samples: int = 6, seed: int = 11, exact: bool = False, block_chars: int = 16 << 20) -> Iterator[BenchmarkIndex]:
    """Indexes of blocks of items, each of about ``block_chars`` characters."""
    bench = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    for b in range(blocks):
        block = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = BenchmarkIndex(found, similarity, target_recall, most_walks, samples, seed, exact)
        if index.items:
            yield index


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row for each (document, item) with a passage within the threshold: RESULT."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = [rows.mapInArrow(_matcher(index), RESULT) for index in indexes(items, **settings)]
    return functools.reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], RESULT)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """docs without the rows that hold a passage of an item; nothing is shuffled."""
    for index in indexes(items, **settings):
        docs = docs.mapInArrow(_keeper(index, docs.columns.index(text_col)), docs.schema)
    return docs


def op7_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
