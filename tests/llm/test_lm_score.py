import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import ctw, lm_score
from vellumspark.llm.lm_score import op2_ctw_score, score_corpus

from . import data


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class BruteTree:
    """Context-tree weighting by dictionaries: nodes (context bytes, bit prefix), straight from the definition."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, collections.Counter(), collections.defaultdict(set)
        for text in texts:
            for context, byte in self.steps(text):
                for j in range(8):
                    prefix, bit = byte >> (8 - j), (byte >> (7 - j)) & 1
                    for n in range(depth + 1):
                        self.counts[context[depth - n :], j, prefix, bit] += 1
                        if n:
                            self.children[context[depth - n + 1 :], j, prefix].add(context[depth - n :])
        self.memo = {}

    def steps(self, text):
        row = bytes([ctw.START]) * self.depth + text + bytes([ctw.END])
        for i in range(self.depth, len(row)):
            yield row[i - self.depth : i], row[i]

    def weight(self, context, j, prefix):
        """(ln Pe, ln of the children's product, ln Pw)"""
        key = (context, j, prefix)
        if key not in self.memo:
            own = log_kt(self.counts[*key, 0], self.counts[*key, 1])
            below = sum(self.weight(c, j, prefix)[2] for c in self.children[key])
            self.memo[key] = own, below, own if len(context) == self.depth else np.logaddexp(own, below) - math.log(2)
        return self.memo[key]

    def score(self, text):
        total = 0.0
        for context, byte in self.steps(text):
            for j in range(8):
                prefix, p = byte >> (8 - j), 0.5
                for n in range(self.depth, -1, -1):
                    at = context[self.depth - n :]
                    zero, one = self.counts[at, j, prefix, 0], self.counts[at, j, prefix, 1]
                    kt = (zero + 0.5) / (zero + one + 1)
                    own, below, _ = self.weight(at, j, prefix)
                    beta = math.exp(min(700, max(-700, own - below)))
                    p = kt if n == self.depth else (beta * kt + p) / (beta + 1)
                total += math.log10(1 - p if (byte >> (7 - j)) & 1 else p)
        return total


def norm(text):
    return b" ".join((text or "").encode().lower().split())


def brute(rows, held, depth):
    learn = [norm(r[1]) for r in rows if not held(r[0])]
    tree, counts = BruteTree(learn, depth), collections.Counter(w for t in learn for w in t.split())
    total, distinct, ends = sum(counts.values()) + len(learn), len(counts) + bool(learn), len(learn)
    out = []
    for doc_id, text, *_ in rows:
        words = [*norm(text).split()]
        c = [*(counts[w] for w in words), ends]
        base = sum(math.log10((x + 0.5) / (total + 0.5 * (distinct + 1))) for x in c)
        out.append((doc_id, held(doc_id), len(c), sum(x > 0 for x in c), total, base, tree.score(norm(text))))
    return out


def crc_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[6])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)


SMALL = [r for r in data.ODD if len(r[1] or "") < 1000] + [(100 + i, t, None, None, None) for i, t in enumerate(data.prose(30, 6))]


def test_query_equals_brute_force(spark, tmp_path):
    d = data.write(spark, tmp_path, documents=spark.createDataFrame(SMALL, data.DOCS).repartition(3))
    got = op2_ctw_score(spark, d)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    assert all(r["n_bytes"] > 0 and r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / r["n_bytes"]) for r in got.collect())
    same([r[:7] for r in got.collect()], brute(SMALL, crc_held, 6))


@pytest.mark.parametrize("depth", [2, 3, 4, 6])
def test_many_blocks_and_small_chunks(spark, depth):
    df = spark.createDataFrame(SMALL, data.DOCS)
    got = score_corpus(df, F.col("doc_id") % 2 == 0, depth=depth, block_bytes=300, least_block_bytes=200, part_bytes=500).collect()
    want = brute(SMALL, lambda i: i is None or i % 2 != 0, depth)
    same([(r["id"], not r["learn"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], want)


def test_probabilities_of_all_bytes_sum_to_one():
    texts = [norm(t) for t in data.prose(20, 7)]
    grams = ctw.gram_keys(ctw.lay_out(texts, 3), 3)
    seen, n = np.unique(grams, return_counts=True)
    every = np.unique(np.concatenate([(np.unique(seen >> np.uint64(8))[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel()]))
    counts = np.zeros(len(every))
    counts[np.searchsorted(every, seen)] = n
    p = ctw.log10_probabilities(every, counts, 3, ctw.Levels(*ctw.top_rows(every, counts, 3), 2, 0).mix)
    assert np.allclose(np.add.reduceat(10**p, np.arange(0, len(every), 256)), 1)


def test_word_hashes_are_of_words_alone():
    rows = [norm(t) for t in data.prose(50, 8)] + [b"", b"one", norm("Ünï 漢字")]
    got, owner = lm_score.word_hashes(ctw.lay_out(rows, 4), lm_score.Powers())
    words = [w for r in rows for w in r.split()]
    assert len(got) == len(words) and owner.tolist() == [i for i, r in enumerate(rows) for _ in r.split()]
    assert len(set(got.tolist())) == len(set(words)) and len(set(zip(got.tolist(), words, strict=True))) == len(set(words))


def test_key_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    keys[0] = 0
    values = rng.normal(size=len(keys))
    assert np.array_equal(ctw.KeyTable(keys, values).get(keys[::-1]), values[::-1])


def test_sums_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    arrays = [(np.unique(rng.integers(0, 900, 80).astype(np.uint64)),) for _ in range(40)]
    arrays = [(k, np.ones(len(k))) for (k,) in arrays]
    whole = lm_score.add_up(iter(arrays))
    monkeypatch.setattr(lm_score, "HELD_KEYS", 50)
    for a, b in zip(whole, lm_score.add_up(iter(arrays)), strict=True):
        assert np.array_equal(a, b)
    assert [len(x) for x in lm_score.add_up([])] == [0, 0]


def test_texts_packed():
    rows = ([b"a b", b"", b"c"], [1, None, -3], [True, False, True])
    texts, ids, learn = lm_score.unpack_texts(*lm_score.pack_texts(*rows))
    assert (texts, ids, learn.tolist()) == rows


def test_repeated_and_null_ids(spark):
    rows = [(None, f"text {i % 3}", None, None, None) for i in range(50)] + [(1, "text 1", None, None, None)] * 30
    got = score_corpus(spark.createDataFrame(rows, data.DOCS).repartition(4), F.lit(True), block_bytes=60, least_block_bytes=50, part_bytes=100).collect()
    want = brute(rows, lambda i: False, 6)
    same([(r["id"], False, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], want)


def test_log_kt_table_and_series():
    a = np.array([0.0, 1, 5, 4095, 4096, 1e6, 0])
    b = np.array([0.0, 0, 7, 4096, 3, 2e6, 1e7])
    assert np.allclose(ctw.log_kt(a, b), [log_kt(x, y) for x, y in zip(a, b, strict=True)], rtol=1e-8, atol=1e-6)


def test_long_texts_empty_tables_and_no_learning_rows(spark):
    assert score_corpus(data.empty(spark), F.lit(True)).count() == 0
    got = {r["id"]: r for r in score_corpus(data.clashing(spark), F.lit(False)).collect()}
    assert got[7]["n_tokens"] == 40_001 and got[7]["n_known"] == 0
    assert got[4]["score"] == pytest.approx(8 * math.log10(0.5)) and got[8]["score"] == pytest.approx(150_001 * 8 * math.log10(0.5), rel=1e-6)
    assert lm_score.CHUNK > 0
