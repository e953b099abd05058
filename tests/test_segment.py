import itertools
import math
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumspark.functions import segment
from vellumspark.functions import text as t

COUNTS = {"a": 5, "ab": 7, "abc": 2, "b": 1, "bc": 4, "ca": 3, "cab": 1}


def every_split(atoms):
    for cuts in itertools.product([False, True], repeat=max(len(atoms) - 1, 0)):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(atoms)]
        yield [atoms[i:j] for i, j in itertools.pairwise(at)]


@settings(max_examples=60, deadline=None)
@given(st.text("abcx", min_size=1, max_size=9))
def test_letters_take_the_likeliest_of_all_splits(run):
    total = sum(COUNTS.values())
    score = lambda p: math.log(COUNTS[p] / total) if p in COUNTS else math.log(10 / total) - len(p) * math.log(10)
    model = segment.UnigramLattice(COUNTS, by_letter=True)
    parts = model(run)
    assert "".join(parts) == run and not any(x not in COUNTS and y not in COUNTS for x, y in itertools.pairwise(parts))
    best = max(sum(map(score, s)) for s in every_split(run) if all(len(p) <= 3 for p in s))
    # an unknown word of the result stands for unknown pieces of at most 3 letters
    ours = sum(score(p) if p in COUNTS else max(sum(map(score, s)) for s in every_split(p) if all(len(x) <= 3 and x not in COUNTS for x in s)) for p in parts)
    assert math.isclose(best, ours)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcx"), max_size=7))
def test_syllables_take_the_likeliest_of_all_groupings(words):
    counts = {"a": 5, "b": 9, "c": 9, "a b": 6, "b c": 2, "a b c": 1}
    total = sum(counts.values())
    score = lambda p: math.log(counts[" ".join(p)] / total) if " ".join(p) in counts else math.log(10 / total) - math.log(10) if len(p) == 1 else -math.inf
    parts = segment.UnigramLattice(counts)(" ".join(words))
    assert "_".join(parts).split("_") == (words or [""])
    assert math.isclose(sum(score(p.split("_")) for p in parts), max(sum(map(score, s)) for s in every_split(words)) if words else 0, abs_tol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcx \U0001f600é", max_size=12), max_size=30), st.integers(1, 200))
def test_a_batch_is_split_as_each_text(texts, at_once):
    old, segment.AT_ONCE = segment.AT_ONCE, at_once
    try:
        for counts in (COUNTS, {"\U0001f600": 3, "aé": 1, "xxxx": 2}, {"a": 1}, {}):
            model = segment.UnigramLattice(counts, by_letter=True)
            assert model.many(texts) == [model(x) for x in texts]
    finally:
        segment.AT_ONCE = old
    model = segment.UnigramLattice({"a b": 2, "c": 1})
    assert model.many(texts) == [model(x) for x in texts]


def test_runs_are_split_together_but_for_very_long_ones():
    model = segment.UnigramLattice(COUNTS, by_letter=True)
    texts = ["abca" * n + " bcx" for n in (1, 2, 15, 17, 40)] * 2
    want, alone, split = [model(x) for x in texts], [], model.split
    model.split = lambda run: alone.append(run) or split(run)
    assert model.many(texts) == want and sorted(map(len, alone)) == [68, 160]


def test_pairs_split_the_texts_once(spark, tmp_path):
    spark.createDataFrame([("a b",)], "x string").write.parquet(f"{tmp_path}/t")
    plan = segment.glued_pairs(spark.read.parquet(f"{tmp_path}/t"), "x", [])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_a_later_word_can_take_what_the_longest_match_would(spark):
    counts = {"học sinh": 50, "học": 20, "sinh": 1, "sinh học": 60}
    df = spark.createDataFrame([("Học sinh học",), ("học SINH.",), (None,)], "x string")
    assert t.LongestMatch(list(counts))("học sinh học") == ["học_sinh", "học"]
    assert [r[0] for r in df.select(t.segmented(segment.UnigramLattice(counts))(F.col("x"))).collect()] == [["học", "sinh_học"], ["học_sinh"], []]


def test_counts(spark):
    df = spark.createDataFrame([("A b a, b a",), ("b",), ("",), (None,), ("x" * 40 + " a",)], "x string")
    assert [tuple(r) for r in segment.word_counts(df, "x").collect()] == [("a", 4), ("b", 3)]
    assert [tuple(r) for r in segment.word_counts(df, "x", most=1).collect()] == [("a", 4)]
    assert sorted(tuple(r) for r in segment.phrase_counts(df, "x", ["a b", "A  b a", "b", "z q"]).collect()) == [("a b", 2), ("a b a", 2), ("b", 3)]
    assert segment.phrase_counts(df, "x", []).count() == 0
    assert sorted(tuple(r) for r in segment.glued_pairs(df, "x", []).filter("length(a) = 1").collect()) == [("a", "b", 2), ("b", "a", 2)]
    assert segment.lattice(df.limit(0).select(F.col("x").alias("word"), F.lit(1).alias("n")), by_letter=True)("ab") == ["ab"]


def test_query_equals_a_plain_count(spark, tmp_path):
    from vellumspark.plans.catalog import QUERIES
    from vellumspark.plans import catalog_sources  # noqa: F401

    rows = [(i, ["The cat sat on the mat", "the dog, the cat!", None, "", "one"][i % 5] + f" w{i % 3} on" if i % 5 != 2 else None, ["en", None][i % 2]) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in rows]
    words = [[w for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()] for _, x, _ in rows]
    counts = {}
    for w in itertools.chain(*[x for x, h in zip(words, held) if not h]):
        counts[w] = counts.get(w, 0) + 1
    model, want = segment.UnigramLattice(counts, by_letter=True), {}
    for (_, _, lang), x, h in zip(rows, words, held):
        for a, b in itertools.pairwise(x) if h else []:
            parts, old = model(a + b), want.get(lang or "und", (0, 0, 0))
            want[lang or "und"] = (old[0] + 1, old[1] + len(parts) - 1, old[2] + (a in ["".join(parts[:i]) for i in range(1, len(parts) + 1)]))
    got = {r["lang"]: (r["n_pairs"], r["n_found"], r["n_right"]) for r in QUERIES["segmented_pairs"](spark, str(tmp_path)).collect()}
    assert got == want and want
