import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import langid, quality
from vellumspark.llm.ftrl import Ftrl, fit_temperature, probabilities
from vellumspark.llm.langid import fit_language_model, ngram_counts, op10_langid_ftrl, predict_language
from vellumspark.llm.quality import fit_quality, op5_quality_ftrl, score_quality

from . import data


def language_rows(n=400):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "tion", "with", "and"], "fr": ["eau", "ment", "que", "ére", "oir"], "de": ["sch", "ung", "keit", "ich", "ö"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 40)))
        rows.append((i, text, lang, "s", len(text)))
    return rows


def test_ftrl_separates_and_l1_makes_zeros():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        y = int(rng.integers(2))
        index = np.array(sorted({int(rng.integers(5)) + 5 * y, 10 + int(rng.integers(50))}))
        rows.append((index, np.ones(len(index)), y))
    dense = Ftrl(60, 1).fit(rows, 3)
    sparse = Ftrl(60, 1, l1=5.0).fit(rows, 3)
    score = lambda w: np.mean([(v @ w[i, 0] + w[-1, 0] > 0) == y for i, v, y in rows])
    assert score(dense) > 0.98 and score(sparse) > 0.95
    assert (sparse[:-1] == 0).sum() > 30 > (dense[:-1] == 0).sum()


def test_temperature_mends_overconfidence():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    p = probabilities(logits)
    labels = np.array([rng.choice(3, p=row) for row in p])
    assert fit_temperature(logits * 4, labels) == pytest.approx(4, rel=0.2)
    assert fit_temperature(logits[:0], labels[:0]) == 1.0


def test_chunked_counts_equal_whole_counts(monkeypatch):
    text = "".join(random.Random(2).choices("abc déß漢", k=5000))
    whole = ngram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 64)
    part = ngram_counts(text)
    assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all() and whole[1].sum() == 3 * 5000 - 3


def test_language_of_held_out_rows(spark, tmp_path):
    rows = language_rows() + [(1000 + i, *r[1:]) for i, r in enumerate(data.ODD)]
    d = data.write(spark, tmp_path, documents=spark.createDataFrame(rows, data.DOCS))
    got = op10_langid_ftrl(spark, d).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    truth = {r[0]: r for r in rows}
    right = [r["lang_pred"] == truth[r["doc_id"]][2] for r in got if r["doc_id"] < 400 and r["held_out"]]
    assert len(right) > 60 and np.mean(right) > 0.97
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        text = truth[r["doc_id"]][1]
        und = text is None or not any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == und and 0 <= r["score"] <= 1 and (r["score"] == 0) == und


def test_language_edge_cases(spark):
    assert fit_language_model(data.empty(spark)).predict("text") == ("und", 0.0)
    one = fit_language_model(spark.createDataFrame(language_rows(50), data.DOCS).filter("lang = 'en'"))
    assert one.predict("text") == ("en", 1.0) and one.predict("123") == ("und", 0.0)
    model = fit_language_model(spark.createDataFrame(language_rows(100), data.DOCS))
    out = predict_language(data.clashing(spark), model)
    assert out.count() == len(data.ODD) and out.columns.count("lang_pred") == 1 and out.columns.count("score") == 1
    assert predict_language(data.empty(spark), model).count() == 0


def quality_tables(spark, n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i, t in enumerate(data.prose(n, 5)):
        bad = rng.random() < 0.3
        rows.append((i, " ".join(f"{w}###" if bad and rng.random() < 0.4 else w for w in t.split()), "en", "s", 0))
        labels.append((i, int(not bad), 0))
    labels += [(0, None, 0), (None, 1, 0), (5, labels[5][1], 1)]
    return spark.createDataFrame(rows, data.DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_quality_of_held_out_rows(spark, tmp_path):
    docs, labels, truth = quality_tables(spark)
    d = data.write(spark, tmp_path, documents=docs.union(data.odd(spark).selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars")), labels=labels)
    got = op5_quality_ftrl(spark, d).collect()
    assert len(got) == 600 + len(data.ODD)
    want = {k: q for k, q, _ in truth if k is not None and q is not None}
    held = [r["predicted"] == want[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(held) > 100 and np.mean(held) > 0.95
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_quality_edge_cases(spark):
    docs, labels, _ = quality_tables(spark, 60)
    weights = fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in score_quality(docs, weights).collect()} == {0.5}
    weights = fit_quality(docs, labels)
    assert score_quality(data.empty(spark), weights).count() == 0
    out = score_quality(data.clashing(spark), weights)
    assert out.count() == len(data.ODD) and out.columns.count("score") == 1
    assert np.array_equal(weights, fit_quality(docs.repartition(3), labels.repartition(5)))


def plain_ftrl(rows, slots, outputs, alpha, l1, l2, epochs, seed=7):
    """The updates of the method one coordinate at a time, in plain Python."""
    size = (slots + 1) * outputs
    z, n = [0.0] * size, [0.0] * size

    def weight(k):
        bare = k // outputs == slots
        if abs(z[k]) <= (0.0 if bare else l1):
            return 0.0
        return -(z[k] - (1 if z[k] > 0 else -1) * (0.0 if bare else l1)) / ((1.0 + n[k] ** 0.5) / alpha + (0.0 if bare else l2))

    turn = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in turn.permutation(len(rows)):
            index, value, label = rows[i]
            entries = [*zip(index.tolist(), value.tolist(), strict=True), (slots, 1.0)]
            logits = [sum(v * weight(s * outputs + o) for s, v in entries) for o in range(outputs)]
            if outputs == 1:
                errors = [1 / (1 + math.exp(-logits[0])) - label]
            else:
                top = max(logits)
                total = sum(math.exp(x - top) for x in logits)
                errors = [math.exp(x - top) / total - (o == label) for o, x in enumerate(logits)]
            old = {s * outputs + o: weight(s * outputs + o) for s, _ in entries for o in range(outputs)}
            for s, v in entries:
                for o in range(outputs):
                    k, g = s * outputs + o, v * errors[o]
                    z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha * old[k]
                    n[k] += g * g
    return np.array([weight(k) for k in range(size)]).reshape(slots + 1, outputs)


def test_ftrl_equals_plain_updates():
    rng = np.random.default_rng(2)
    for outputs in (1, 3):
        rows = [(np.sort(rng.choice(20, 4, replace=False)), rng.random(4), int(rng.integers(max(2, outputs)))) for _ in range(60)]
        got = Ftrl(20, outputs, alpha=0.7, l1=0.05, l2=0.1).fit(rows, 2)
        assert np.allclose(got, plain_ftrl(rows, 20, outputs, 0.7, 0.05, 0.1, 2), atol=1e-9)


def test_quality_query_equals_a_plain_model(spark, tmp_path):
    docs, labels, truth = quality_tables(spark, 120)
    d = data.write(spark, tmp_path, documents=docs, labels=labels)
    rows = [tuple(r) for r in docs.collect()]
    marked = {}
    for k, q, _ in truth:
        if k is not None and q is not None and zlib.crc32(str(k).encode()) % 3 != 1:
            marked[k] = max(q, marked.get(k, 0))
    hashes = quality.TokenHashes()
    draw = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:12], 16)
    learn = [(*quality.features(rows[k][1], hashes), marked[k]) for k in sorted(marked, key=lambda k: (draw(k), k))]
    slots = {s: i for i, s in enumerate(sorted({int(s) for index, *_ in learn for s in index}))}
    small = [(np.array([slots[int(s)] for s in index]), value, label) for index, value, label in learn]
    w = plain_ftrl(small, len(slots), 1, 1.0, 1e-3, 1e-3, 3)[:, 0]
    want = {}
    for k, text, *_ in rows:
        index, value = quality.features(text, hashes)
        known = [(slots[int(s)], v) for s, v in zip(index, value, strict=True) if int(s) in slots]
        want[k] = 1 / (1 + math.exp(-(sum(w[s] * v for s, v in known) + w[-1])))
    for r in op5_quality_ftrl(spark, d).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-5)


def test_language_query_equals_a_plain_model(spark, tmp_path):
    rows = language_rows(90)
    d = data.write(spark, tmp_path, documents=spark.createDataFrame(rows, data.DOCS))
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    drawn = spark.createDataFrame(learn, data.DOCS).select("doc_id", F.shiftrightunsigned(F.xxhash64("lang", F.col("doc_id").cast("string"), "text"), 32).alias("draw")).collect()
    draw = {r["doc_id"]: r["draw"] for r in drawn}
    grams = {r[0]: langid.ngram_counts(r[1]) for r in rows}
    df = np.zeros(langid.SLOTS)
    for r in learn:
        df[grams[r[0]][0]] += 1
    idf = np.log((1.0 + len(learn)) / (1.0 + df)) + 1.0
    languages = sorted({r[2] for r in learn})
    order = sorted(learn, key=lambda r: (draw[r[0]], r[2], len(grams[r[0]][0]), grams[r[0]][1].sum()))
    vector = lambda k: langid.tf_idf(*grams[k], idf)
    slots = {s: i for i, s in enumerate(sorted({int(s) for r in rows for s in grams[r[0]][0]}))}
    index = lambda k: np.array([slots[int(s)] for s in grams[k][0]])
    some = {r[2] for r in order if draw[r[0]] % 5}
    kept = [(index(r[0]), vector(r[0]), languages.index(r[2])) for r in order if draw[r[0]] % 5 or r[2] not in some]
    w = plain_ftrl(kept, len(slots), len(languages), 2.0, 1e-3, 1e-3, 3)
    logits = lambda k: vector(k) @ w[index(k)] + w[-1]
    held = [r for r in order if draw[r[0]] % 5 == 0]
    t = fit_temperature(np.array([logits(r[0]) for r in held]).reshape(-1, len(languages)), np.array([languages.index(r[2]) for r in held], np.int64))
    for r in op10_langid_ftrl(spark, d).collect():
        p = probabilities(logits(r["doc_id"])[None], t)[0]
        assert r["lang_pred"] == languages[int(np.argmax(p))] and r["score"] == pytest.approx(p.max(), abs=1e-4)


def test_letters_are_of_category_l(spark):
    model = fit_language_model(spark.createDataFrame(language_rows(60), data.DOCS))
    for text in ("½", "²", "Ⅷ", "①", "12 ½!"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("漢")[0] != "und"


def test_every_language_is_learned(spark):
    rows = [(None, r[1], r[2], "s", 0) for r in language_rows(300)] + [(7, "ǂxyzzy ǂplugh ǂxyzzy", "rare", "s", 0)] + [(None, "hot text that repeats", "en", "s", 0)] * 400
    docs = spark.createDataFrame(rows, data.DOCS)
    model = fit_language_model(docs, per_label=40)
    assert model.languages == ["de", "en", "fr", "rare"] and model.predict("ǂplugh ǂxyzzy")[0] == "rare"
    right = [model.predict(r[1])[0] == r[2] for r in language_rows(300)]
    assert np.mean(right) > 0.9


def test_repeated_labelled_rows_are_learned_once(spark):
    docs, labels, _ = quality_tables(spark, 60)
    many = docs.union(docs).union(docs)
    assert np.array_equal(fit_quality(docs, labels), fit_quality(many, labels.union(labels)))
