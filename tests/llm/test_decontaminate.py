import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm.decontaminate import BenchmarkIndex, _match_batch, decontaminate, infix_distance, leaks, op7_decontaminate_cgk

from . import data

ITEMS = "item_id long, text string"


def brute_infix(item, text):
    """Least edit distance of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_infix_distance():
    rng = random.Random(0)
    for _ in range(300):
        item = np.array([rng.randint(1, 5) for _ in range(rng.randint(1, 12))])
        text = np.array([rng.randint(0, 5) for _ in range(rng.randint(0, 25))], np.int64)
        distance, a, b = infix_distance(item, text)
        assert distance == brute_infix(item, text)
        assert 0 <= a <= b <= len(text) and brute_infix(item, text[a:b]) == distance


def edited(words, k, rng, pool):
    out = list(words)
    for _ in range(k):
        p, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.6:
            out[p] = rng.choice(pool)
        elif kind < 0.8:
            out.insert(p, rng.choice(pool))
        else:
            del out[p]
    return out


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.1, 0.97), (0.2, 0.9)])
def test_recall(rate, least):
    rng = random.Random(7)
    items = [(i, t) for i, t in enumerate(data.prose(150, 8, words=60, vocabulary=3000)) if len(t.split()) >= 10]
    pool = " ".join(data.prose(100, 9, vocabulary=3000)).split()
    index, hits, clean = BenchmarkIndex(items, 0.8), 0, 0
    for i, text in items:
        words = edited(text.split(), int(rate * len(text.split())), rng, pool)
        doc = " ".join(rng.choices(pool, k=50) + words + rng.choices(pool, k=50))
        hits += any(r[1] == i for r in _match_batch(index, [(0, doc)]))
        clean += len(list(_match_batch(index, [(0, " ".join(rng.choices(pool, k=150)))])))
    assert hits >= least * len(items) and clean == 0


def changed(words, k, kind, rng, pool):
    if kind == "mixed":
        return edited(words, k, rng, pool)
    out = list(words)
    for _ in range(k):
        p = rng.randrange(len(out))
        if kind == "insertions":
            out.insert(p, rng.choice(pool))
        else:
            del out[p]
    return out


@pytest.mark.parametrize("kind", ["insertions", "deletions", "mixed"])
@pytest.mark.parametrize("length", [5, 9, 40, 100, 150, 200, 300, 400])
def test_recall_is_whole_at_every_length(length, kind):
    rng = random.Random(length)
    pool = " ".join(data.prose(300, 9, vocabulary=3000)).split()
    items = [(i, " ".join(rng.choices(pool, k=length))) for i in range(20)]
    index = BenchmarkIndex(items, 0.8, exact=True)
    for i, text in items:
        words = changed(text.split(), length // 5, kind, rng, pool)
        doc = " ".join(rng.choices(pool, k=50) + words + rng.choices(pool, k=50))
        assert any(r[1] == i and r[2] <= length // 5 for r in _match_batch(index, [(0, "one before"), (1, doc)]))


def test_matches_are_those_of_brute_force():
    rng = random.Random(5)
    for similarity in (0.6, 0.8, 0.95, 1.0):
        pool = [f"w{i}" for i in range(40)]
        items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 30)))) for i in range(25)]
        index = BenchmarkIndex(items, similarity, most_walks=2, exact=True)
        docs = [(d, " ".join(rng.choices(pool, k=rng.randint(0, 20)) + edited(rng.choice(items[:20])[1].split() * 2, d % 5, rng, pool) + rng.choices(pool, k=rng.randint(0, 20)))) for d in range(20)]
        got = {(r[0], r[1]): r[2] for r in _match_batch(index, docs)}
        want = {}
        for d, text in docs:
            for i, item in items:
                least = brute_infix(item.split(), text.split())
                if least <= int((1 - similarity) * len(item.split()) + 1e-9):
                    want[d, i] = least
        assert got == want


def test_results_are_verified_and_spans_are_right(spark, tmp_path):
    items = [(1, "One two, three four five six seven eight nine ten."), (2, None), (3, ""), (4, "lonely"), (5, "alpha beta gamma delta")]
    docs = [
        (10, "Before. ONE two three four five SIX seven eight nine ten! After", None, None, None),
        (11, "one two three four five six other words nine ten", None, None, None),
        (12, "one two three four other other other eight nine ten", None, None, None),
        (13, "a lonely word", None, None, None),
    ]
    d = data.write(spark, tmp_path, documents=spark.createDataFrame(docs + data.ODD, data.DOCS), benchmark=spark.createDataFrame(items, ITEMS))
    got = {(r["doc_id"], r["item_id"]): r for r in op7_decontaminate_cgk(spark, d).collect()}
    assert {k for k in got if k[0] and k[0] >= 10} == {(10, 1), (11, 1), (13, 4)}
    assert {k[0] for k in got if k[1] == 5} == {1, 2, 3, None}
    r = got[10, 1]
    assert r["distance"] == 0 and docs[0][1][r["char_start"] : r["char_end"]].lower() == "one two three four five six seven eight nine ten"
    assert got[11, 1]["distance"] == 2 and got[11, 1]["similarity"] == pytest.approx(0.8)


def test_blocks_of_items_and_filter(spark):
    texts = data.prose(40, 12, words=40, vocabulary=2000)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:20])], ITEMS)
    docs = spark.createDataFrame([(i, f"start {t} end", None, None, None) for i, t in enumerate(texts)] + data.ODD, data.DOCS)
    one = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()}
    many = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items, block_chars=300).collect()}
    assert one == many and {(i, i) for i in range(20)} <= one
    kept = [r["doc_id"] for r in decontaminate(docs, items).collect()]
    assert sorted(kept, key=str) == sorted([r[0] for r in docs.collect() if (r[0], r[1]) not in {(i, f"start {t} end") for i, t in enumerate(texts[:20])}], key=str)


def test_walks_reach_the_target_by_themselves():
    rng = random.Random(3)
    pool = " ".join(data.prose(300, 9, vocabulary=3000)).split()
    for length in (8, 20, 60, 150, 500, 1000):
        items = [(i, " ".join(rng.choices(pool, k=length))) for i in range(12)]
        index = BenchmarkIndex(items, 0.8, target_recall=0.9)
        assert min(index.recalls.values()) >= 0.9
        found = 0
        for i, text in items:
            words = edited(text.split(), length // 5, rng, pool)
            ids = np.array([index.vocabulary.get(w, 0) for w in rng.choices(pool, k=30) + words + rng.choices(pool, k=2 * length)] + [0] * 2 * length)
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            seen = [index.walked(ids, items_, starts, known) for _, items_, starts in index.seeded(ids, np.array([0]))]
            found += any((c[:, 1] == i).any() for c in seen)
        assert found >= 9


@pytest.mark.parametrize("length", [5, 10, 20, 40, 100, 200, 400, 1000])
def test_the_walks_decide(length, monkeypatch):
    """Copies with all edits that are allowed are found at the target's rate by the walks, none without them, exact copies always."""
    rng = random.Random(length)
    pool = " ".join(data.prose(300, 9, vocabulary=3000)).split()
    items = [(i, " ".join(rng.choices(pool, k=length))) for i in range(40)]
    docs = [(i, " ".join(rng.choices(pool, k=30) + edited(t.split(), length // 5, rng, pool) + rng.choices(pool, k=30))) for i, t in items]
    copies = [(i, f"one before {t} and one after") for i, t in items]
    index = BenchmarkIndex(items, 0.8)
    assert min(index.recalls.values()) >= 0.99
    assert len({r[0] for r in _match_batch(index, docs) if r[0] == r[1]}) >= 38
    assert {r[0] for r in _match_batch(index, copies) if r[0] == r[1] and r[2] == 0} == set(range(40))
    monkeypatch.setattr(index, "walked", lambda *a: np.zeros((0, 2), np.int64))
    assert not list(_match_batch(index, docs + copies))


def test_target_sets_the_repetitions():
    items = [(i, t) for i, t in enumerate(data.prose(60, 8, words=60, vocabulary=3000))]
    few, many = BenchmarkIndex(items, target_recall=0.3), BenchmarkIndex(items, target_recall=0.99)
    codes = lambda x: sum(len(c["sets"]) for c in x.classes)
    assert codes(few) < codes(many)


def test_repeated_items_and_clashing_columns(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")] * 50 + [(2, "alpha beta gamma delta")], ITEMS).withColumn("id", F.lit("x"))
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in leaks(data.clashing(spark), items).collect())
    assert got == sorted((str(i), k) for i in (1, 2, 3, None) for k in (1, 2))
    kept = decontaminate(data.clashing(spark), items)
    assert kept.columns == data.clashing(spark).columns and kept.count() == len(data.ODD) - 4
    assert {r["id"] for r in kept.collect()} == {"clash"}


def test_letters_that_grow_when_lowered():
    text = "İİ " * 3 + "one two three four five"
    (r,) = _match_batch(BenchmarkIndex([(1, "one two three four five")]), [(0, text)])
    assert text[r[6] : r[7]] == "one two three four five"


def test_empty(spark):
    items = spark.createDataFrame([(1, "some words here")], ITEMS)
    assert leaks(data.empty(spark), items).count() == 0
    assert leaks(data.odd(spark), items.limit(0)).count() == 0
    assert decontaminate(data.clashing(spark), items.limit(0)).count() == len(data.ODD)
