import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import collocations as co
from vellumspark.llm import mph

from . import data

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, most=2000, covered=80):
    counts, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    often = {p: a for p, a in counts.items() if a >= least}
    inside = Counter()
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = []
    for lang in {x for x, _ in often}:
        mine = []
        for (x, w), a in often.items():
            if x != lang or len(w) < 2 or ((lang, w) in inside and 100 * inside[lang, w] >= covered * a):
                continue
            s, _, left, right = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            mine.append((-s, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(mine)[:most])]
    return sorted(out)


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def corpus(n=400, seed=4):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["New York", "in the end of", "Été", "naïve ß", "a.b", "x\tY", "\x00", "\xa0"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=np.r_[np.full(60, 0.7 / 60), np.full(8, 0.3 / 8)])) + rng.choice([".", "!\n", "\r\n;", " "]) for _ in range(n)]
    langs = rng.choice(["en", "de", "und", ""], n)
    return [(i, t, None if lang == "" else str(lang), None, None) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]


@pytest.mark.parametrize("options", [{}, {"most": 7}, {"least": 3, "covered": 60, "most_keys": 400}, {"least": 2, "most_bits": 16, "most": 100000}])
def test_equals_brute_force(spark, options, monkeypatch):
    if "most_keys" in options:  # several shards and blocks
        monkeypatch.setattr(co, "SHARD_KEYS", 100)
        monkeypatch.setattr(co, "FAN_IN", 2)
    rows = corpus()
    got = found(co.collocations(spark.createDataFrame(rows, data.DOCS).repartition(9), **options))
    assert got == brute(rows, **{k: v for k, v in options.items() if k in ("least", "most", "covered")}) and len(got) > 10


def test_odd_rows(spark):
    rows = data.ODD + [(20 + i, "to be, or not to be", lang, None, None) for i in range(40) for lang in ("en", None)]
    df = spark.createDataFrame(rows, data.DOCS)
    assert found(co.collocations(df)) == brute(rows)
    clash = df.withColumns({c: F.lit("clash") for c in [*data.CLASH, "words", "run", "word", "hash", "k1", "a", "l", "r", "shard", "part"]})
    assert found(co.collocations(clash)) == brute(rows)
    assert found(co.collocations(data.empty(spark))) == [] and found(co.collocations(spark.createDataFrame([(1, None, None, None, None)], data.DOCS))) == []


def test_long_text_in_slices(spark, monkeypatch):
    """Slices and runs end inside a text without a change of its phrases, with and without ends of pieces."""
    monkeypatch.setattr(co, "_STEP", 50)
    monkeypatch.setattr(co, "_RUN", 100)
    rows = [(0, "one two three four five " * 900, "en", None, None), (1, "one two, three four. five six " * 900, "en", None, None)]
    assert found(co.collocations(spark.createDataFrame(rows, data.DOCS))) == brute(rows)


def test_a_hot_phrase_and_ties(spark):
    rows = [(i, "same old story again", "en", None, None) for i in range(300)] + [(300 + i, f"b{i % 9} c{i % 9}. z a", "en", None, None) for i in range(360)]
    got = found(co.collocations(spark.createDataFrame(rows, data.DOCS).repartition(40), most=5))
    assert got == brute(rows, most=5)


def test_exact_arithmetic(spark):
    big = 2**62
    row = spark.createDataFrame([(big, big, big - 1)], "a long, l long, r long").select(co.score("a", "l", "r").alias("s")).first()
    assert row["s"] == 2000000 * big // (2 * big - 1)


def test_perfect_hash():
    rng = np.random.default_rng(0)
    h, g = rng.integers(0, 2**63, (2, 50_000)).astype(np.uint64)
    parts = [np.flatnonzero(h % np.uint64(7) == s) for s in range(7)]
    built = [mph.build(h[p], g[p]) for p in parts]
    made = mph.Mph(0, 7, [b[0] for b in built], [b[1] for b in built])
    slots = made.slots(h, g)
    assert sorted(slots.tolist()) == list(range(50_000))
    assert np.concatenate([p[b[2]] for p, b in zip(parts, built, strict=True)]).tolist() == np.argsort(slots).tolist()
    some = mph.Mph(2, 7, [b[0] for b in built[2:5]], [b[1] for b in built[2:5]])
    inner = np.concatenate(parts[2:5])
    assert sorted(some.slots(h[inner], g[inner]).tolist()) == list(range(len(inner))) and (some.slots(h[parts[0]], g[parts[0]]) == -1).all()
    with pytest.raises(RuntimeError):
        mph.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_stored_keys_decide():
    """Phrases that were never put in are told by their keys, whatever slot they hash to."""
    keys = np.random.default_rng(1).integers(1, 2**62, (500, 4)).astype(np.uint64)
    h, g = co.hashes_of(list(keys.T))
    sizes, words, order = mph.build(h, g)
    block = co.Block([{"shard": 0, "n": 500, "sizes": sizes, "words": words.tobytes(), "keys": keys[order].tobytes()}], 1, 0)
    other = np.random.default_rng(2).integers(1, 2**62, (5000, 4)).astype(np.uint64)
    assert (block.mph.slots(*co.hashes_of(list(other.T))) >= 0).any() and (block.slots(list(other.T)) == -1).all()
    assert sorted(block.slots(list(keys.T)).tolist()) == list(range(500))


def test_query(spark, tmp_path):
    rows = corpus(300, 8)
    d = data.write(spark, tmp_path, documents=spark.createDataFrame(rows, data.DOCS))
    assert found(co.op11_collocations(spark, d)) == brute(rows)
