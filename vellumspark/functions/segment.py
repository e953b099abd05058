"""Word segmentation by a unigram lattice whose frequencies Spark counts from a corpus."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens

#: Pieces that are weighed together, and letters from which on runs are split by themselves.
AT_ONCE, MOST_LETTERS = 1 << 17, 64
#: Above all code points: what stands behind the end of a shorter run.
PAST = (1 << 21) - 1


def code_points(words: list[str]) -> np.ndarray:
    """A row of numbers for each word, filled up with PAST."""
    lengths = np.array([len(x) for x in words], np.int64)
    out = np.full((len(words), int(lengths.max(initial=0))), PAST, np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


class Trie:
    """The beginnings of words by their length, as sorted numbers: a beginning one letter shorter, and a letter."""

    def __init__(self, scores: dict[str, float]):
        letters, node, count = code_points(list(scores)), np.zeros(len(scores), np.int64), 1
        self.levels, self.first, ends = [], [], node.copy()
        for column in letters.T:
            longer = column != PAST
            keys, place = np.unique(node[longer] << 21 | column[longer], return_inverse=True)
            node[longer] = ends[longer] = count + place
            self.levels.append(np.append(keys, np.iinfo(np.int64).max))
            self.first.append(count)
            count += len(keys)
        self.score = np.full(count, -np.inf)  # of beginnings that are no words
        self.score[ends] = list(scores.values())

    def step(self, depth: int, node: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the beginnings of this length go on with their letter in a word, and as which beginnings."""
        keys = node << 21 | letters if depth else letters
        place = np.searchsorted(self.levels[depth], keys)
        found = self.levels[depth][place] == keys
        return found, self.first[depth] + place[found]


class UnigramLattice:
    """Splits into the words whose frequencies have the largest product (Viterbi); for ``segmented``.

    by_letter: runs without spaces are split into words.  A piece of n letters that is
    not known has probability 10 / (N * 10**n), N being all counts; neighbouring unknown
    pieces are one word.  Else syllables between spaces are grouped and joined by
    underscores (keys of ``counts`` have spaces); an unknown syllable stays alone.  Ties
    go to the longer last word.  Time is the length times the longest known word.
    """

    def __init__(self, counts: dict[str, int], by_letter: bool = False):
        self.by_letter, self.total = by_letter, max(sum(counts.values()), 1)
        self.known = {k if by_letter else tuple(k.split(" ")): math.log(n / self.total) for k, n in counts.items()}
        self.longest = max(map(len, self.known), default=1)
        self.unknown = [math.log(10 / self.total) - n * math.log(10) if by_letter or n == 1 else -math.inf for n in range(self.longest + 1)]
        self.trie = Trie(self.known) if by_letter else None

    def split(self, atoms: str | tuple[str, ...]) -> list:
        best, start, known = [0.0], [0], self.known
        for end in range(1, len(atoms) + 1):
            top, where = -math.inf, end - 1
            for at in range(max(0, end - self.longest), end):
                score = known.get(atoms[at:end])
                if score is None:
                    score = self.unknown[end - at]
                if best[at] + score > top:
                    top, where = best[at] + score, at
            best.append(top)
            start.append(where)
        return self._pieces(atoms, start)

    def _pieces(self, atoms: str | tuple[str, ...], start: list[int] | bytes) -> list:
        """Of each end where its last piece starts: the pieces, unknown neighbours joined."""
        pieces, end = [], len(atoms)
        while end:
            pieces.append(atoms[start[end] : end])
            end = start[end]
        pieces.reverse()
        if not self.by_letter or all(map(self.known.__contains__, pieces)):
            return pieces
        out: list = []
        for piece in pieces:
            if out and piece not in self.known and out[-1] not in self.known:
                out[-1] += piece
            else:
                out.append(piece)
        return out

    def _starts(self, runs: list[str]) -> list[bytes]:
        """``split``'s table of starts for many runs of letters: the same sums in the same order, each step for all runs."""
        points = code_points(runs)
        n, size = points.shape
        longest = min(self.longest, size)
        letters = np.append(points.T, np.full(longest * n, PAST))  # one place of all runs after the other, and past their ends
        scores = np.empty((longest, size * n))  # of the pieces of each length, by start and run
        scores[:] = np.array(self.unknown[1 : longest + 1])[:, None]
        begin, node = np.arange(size * n), np.zeros(size * n, np.int64)
        for depth in range(min(longest, len(self.trie.levels))):
            found, node = self.trie.step(depth, node, letters[begin + depth * n])
            begin = begin[found]
            known = self.trie.score[node]
            words = known > -np.inf
            scores[depth, begin[words]] = known[words]
        scores = scores.reshape(longest, size, n)
        best, start = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.uint8)
        best[0] = 0.0
        for at in range(size):
            ends = slice(at + 1, min(at + longest, size) + 1)
            score = best[at] + scores[: ends.stop - ends.start, at]
            better = score > best[ends]
            np.copyto(best[ends], score, where=better)
            np.copyto(start[ends], at, where=better)
        held = start.T.tobytes()
        return [held[i : i + size + 1] for i in range(0, len(held), size + 1)]

    def many(self, texts: Iterable[str]) -> list[list[str]]:
        """What a call gives for each text; runs of letters are split together, each of them once."""
        if not self.by_letter:
            return [self(x) for x in texts]
        listed = [[x for x in text.split(" ") if x] for text in texts]
        runs = sorted(set(itertools.chain.from_iterable(listed)), key=len)
        pieces, begin = {}, 0
        while begin < len(runs):
            size = len(runs[begin])
            end = begin + max(1, AT_ONCE // (size * min(size, self.longest)))
            some = list(itertools.takewhile(lambda x: len(x) <= size + size // 8, runs[begin:end]))  # noqa: B023
            starts = self._starts(some) if size < MOST_LETTERS else None
            pieces |= {x: self._pieces(x, starts[i]) if starts else self.split(x) for i, x in enumerate(some)}
            begin += len(some)
        return [pieces[held[0]] if len(held) == 1 else [p for x in held for p in pieces[x]] for held in listed]

    def __call__(self, text: str) -> list[str]:
        runs = [x for x in text.split(" ") if x]
        return [p for run in runs for p in self.split(run)] if self.by_letter else ["_".join(p) for p in self.split(tuple(runs))]


def word_counts(texts: DataFrame, text_col: str, most: int = 100_000, longest: int = 30) -> DataFrame:
    """(word, n): the commonest words of at most ``longest`` letters in all texts, ``most`` of them, which bounds the model that tasks get; ties by word."""
    counted = texts.select(F.explode(tokens(F.col(text_col))).alias("word")).filter(F.length("word") <= longest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(most)


def phrase_counts(texts: DataFrame, text_col: str, phrases: list[str]) -> DataFrame:
    """(word, n): how often each of the given phrases stands in the texts, overlaps included; phrases are the caller's list, and so of its size."""
    known = [" ".join(p.lower().split()) for p in phrases]
    if not known:
        return texts.sparkSession.createDataFrame([], "word string, n bigint")
    sizes = sorted({p.count(" ") + 1 for p in known})
    listed = texts.select(tokens(F.col(text_col)).alias("t"))

    def runs(n: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))
        return F.when(F.size("t") >= n, all_).otherwise(F.array().cast("array<string>"))

    held = F.broadcast(texts.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(known)], "word string"))
    found = listed.select(F.explode(F.flatten(F.array(*map(runs, sizes)))).alias("word"))
    return found.join(held, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def lattice(counts: DataFrame, by_letter: bool = False) -> UnigramLattice:
    """The model from bounded (word, n) rows; the same word in several rows is summed."""
    rows = counts.groupBy("word").agg(F.sum("n").alias("n")).collect()
    return UnigramLattice({r["word"]: int(r["n"]) for r in rows}, by_letter)


def glued_pairs(texts: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, a, b, n): neighbouring words of a text and how often they stand so, to test a segmenter on."""
    listed, n = texts.select(*keys, tokens(F.col(text_col)).alias("t")), F.size("t")  # no filter by size: it would split the texts once more
    pairs = F.arrays_zip(F.slice("t", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("t", F.lit(2), n))
    return listed.select(*keys, F.inline(pairs).alias("a", "b")).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
