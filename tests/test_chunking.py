import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumspark.operators import chunking as c
from vellumspark.schemas import CHUNKS, RAW_ARTICLES, from_legal

X1 = "Intro line[1]\nmore\n\n| a | b |\n| c | d |\n- one\n\n- two\n3. three\n$x^2$\nProse again"


def test_structured():
    assert c.structured(X1).split("\n\n") == ["Intro line", "more", "| a | b |\n| c | d |", "- one", "- two\n3. three", "$x^2$", "Prose again"]
    assert c.structured(X1, "\n").startswith("Intro line\nmore\n\n| a")
    assert c.structured("") == c.structured(None) == ""


@pytest.mark.parametrize("profile", list(c.SEPARATORS))
@given(text=st.text(alphabet="ab .,;\n!?Điều 1#-", max_size=400))
@settings(max_examples=40, deadline=None)
def test_split_covers_all_and_keeps_size(profile, text):
    parts = c.split_text(text, c.SEPARATORS[profile], 60, 15, profile.endswith("_sub"))
    if c.SEPARATORS[profile][-1] == "":
        assert all(len(p) <= 60 for p in parts)
    assert all(p == p.strip() and p for p in parts)
    left = list("".join("".join(parts).split()))
    if profile.endswith("_sub"):  # separators stay, so every visible character is somewhere
        for x in set("".join(text.split())):
            assert left.count(x) >= text.count(x)


def test_split_shapes():
    general = c.SEPARATORS["general"]
    assert c.split_text("short", general) == ["short"] and c.split_text("", general) == []
    whole = c.split_text("x" * 3000, general)
    assert [len(p) for p in whole][:2] == [1024, 1024] and whole[0][-200:] == whole[1][:200]
    assert len(c.split_text("x" * 3000, c.SEPARATORS["legal_sub"], keep=True)[0]) == 3000
    law = "\n\nĐiều 1. " + "a" * 600 + "\n\nĐiều 2. " + "b" * 600
    assert [p[:7] for p in c.split_text(law, c.SEPARATORS["legal_sub"], keep=True)] == ["Điều 1.", "Điều 2."]


def test_rows_equal_arrays_for_odd_texts(spark):
    many = ["", None, " ", "word " * 3000, "x" * 5000, "a. b! c? " * 400, "\n\n".join("para " * i for i in range(60)), "short"] * 3
    df = spark.createDataFrame([(i, x, "k" * (i % 3)) for i, x in enumerate(many)], "id int, text string, other string").repartition(3)
    for profile in ("general", "legal_sub", "wiki"):
        want = {(r["id"], r["other"], r["pos"], r["col"]) for r in df.select("id", "other", F.posexplode(c.split_column(F.col("text"), profile))).collect()}
        got = [tuple(r) for r in c.split_rows(df, "text", ["id", "other"], profile).collect()]
        assert len(got) == len(want) and set(got) == want
    assert c.split_rows(df.limit(0), "text", ["id"]).count() == 0
    small = c.piece_rows(df, lambda x: iter((x or "").split()), ["text"], ["id"], held_chars=50)  # many batches for each text
    assert small.count() == sum(len((x or "").split()) for x in many)
    with pytest.raises(ValueError):
        c.split_rows(df.withColumn("Content", F.lit(1)), "text", ["Content"])


def test_pieces_of_a_long_text_are_made_one_at_a_time():
    text = "Some words of a sentence, and more. " * 300_000  # over 10 MB
    made = c.split_pieces(text, c.SEPARATORS["general"])
    law = c.statute_articles("\n".join(f"Điều {i}. " + "nội dung " * 20 for i in range(40_000)), "t", c.STATUTE_RULES["strict"])
    tracemalloc.start()
    n = sum(1 for _ in zip(made, range(10_000), strict=False)) + sum(1 for _ in zip(law, range(40_000), strict=False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 50_000
    assert peak < 2_000_000


def test_domain_callback(spark):
    rows = [(f"T{i}", "u", "Some clause of it; and one more. " * 60, None, [x], None) for i, x in enumerate(["law", "code", "none"])]
    df = spark.createDataFrame(rows, RAW_ARTICLES)
    own = lambda category: F.when(category == "law", "legal").when(category == "code", "unheard-of")
    got = {r["doc_title"]: r["domain"] for r in c.chunk_articles(df, "sub", domain_of=own).collect()}
    assert got == {"T0": "legal", "T1": "unheard-of", "T2": "general"}
    assert {r["domain"] for r in c.chunk_new(df, df.filter("title = 'T0'").select("title"), domain_of=own).collect()} == {"unheard-of", "general"}


STATUTE = "QUỐC HỘI\nLời nói đầu\nCHƯƠNG I\nCHẾ ĐỘ CHÍNH TRỊ\nĐiều 1. Nước\nThân một\nTải về\nĐiều 2.\nCHƯƠNG II\nĐiều 3. Ba\nThân ba"


def test_statutes():
    got = c.parse_statute(STATUTE, "HP", c.STATUTE_RULES["strict"])
    assert got == ["Văn bản: HP\nCHƯƠNG I - CHẾ ĐỘ CHÍNH TRỊ\nĐiều 1. Nước\nThân một", "Văn bản: HP\nCHƯƠNG I - CHẾ ĐỘ CHÍNH TRỊ\nĐiều 2.", "Văn bản: HP\nCHƯƠNG II\nĐiều 3. Ba\nThân ba"]
    assert [a.split("\n")[1] for a in c.parse_statute(STATUTE, "HP", c.STATUTE_RULES["v1"])] == ["CHƯƠNG I", "CHƯƠNG I", "CHƯƠNG II"]
    assert len(c.parse_statute("Mở đầu. Điều 1. A.Điều 2. B", "t", c.STATUTE_RULES["v3"])) == 2
    assert c.parse_statute(None, "t", c.STATUTE_RULES["strict"]) == []


@pytest.mark.parametrize("profile", ["stem", "sub", "wiki"])
def test_chunk_table(spark, profile):
    text = "A sentence about things that happen. " * 80 + ("\nTham khảo:\nrefs" if profile == "wiki" else "\n== Tham khảo ==\nrefs")
    rows = [("T", "u", text, None, ["Toán_học", "Đại_số"], None), ("Short", "u", "tiny", None, None, None), ("Null", "u", None, None, [], None)]
    got = c.chunk_articles(spark.createDataFrame(rows, RAW_ARTICLES), profile)
    assert {f"{n} {k}" for n, k in got.dtypes} == {x.strip() for x in CHUNKS.split(",")}
    rows = got.orderBy("chunk_index").collect()
    assert rows and all(r["doc_title"] == "T" and "refs" not in r["display_text"] for r in rows)
    # the header is a chunk of its own before so long a sentence run, too short to keep: ids may have gaps
    assert rows[0]["chunk_id"] == ("T_0" if profile == "wiki" else "T_1") and len({r["chunk_id"] for r in rows}) == len(rows)
    if profile != "wiki":
        assert rows[0]["domain"] == "stem" and all(r["char_count"] <= 1024 for r in rows)


def test_incremental_equals_full(spark):
    rows = [(f"T{i}", "u", f"Words of article {i}. " * 20, None, ["a"], None) for i in range(6)]
    df = spark.createDataFrame(rows, RAW_ARTICLES)
    full = {r["chunk_id"] for r in c.chunk_articles(df).collect()}
    done = df.filter("title < 'T3'")
    assert full == {r["chunk_id"] for r in c.chunk_articles(done).union(c.chunk_new(df, done.select("title"))).collect()}


def test_legal_adapter(spark):
    raw = spark.createDataFrame([("t", "cat", "u", "body", "now")], "doc_title string, doc_category string, doc_url string, doc_content string, crawled_at string")
    assert from_legal(raw).first()["categories"] == ["cat"]


def python_steps(df):
    """(steps that stream rows, steps that hold a batch's results) in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("MapInArrow "), plan.count("EvalPython ")


@pytest.mark.parametrize("name,steps", [("chunk_table", 1), ("chunk_table_wiki", 2), ("incremental_titles", 1), ("structured_clean", 1), ("split_cover", 1), ("split_tokens", 1), ("law_fields", 1)])
def test_texts_pass_python_as_a_stream_of_rows(spark, tmp_path, name, steps):
    from __spark_entry__ import queries

    rows = [(i, x, "en", "a", 5) for i, x in enumerate(["Some text. " * 40, None, "", "é | x\n- y\n\n" * 30])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert python_steps(queries()[name](spark, str(tmp_path))) == (steps, 0)


def test_rows_of_streamed_steps_are_those_of_their_columns(spark):
    from vellumspark.operators import pages

    df = spark.createDataFrame([(i, x) for i, x in enumerate(["Some text.\n- a\n- b\n\nMore [1] of it. " * 9, None, "", "é\n\n# References\nx"])], "id long, x string")
    for profile in ("stem", "sub"):
        assert sorted(c.structured_rows(df, "x", ["id"], profile).collect()) == sorted(df.select("id", c.clean_structured(F.col("x"), profile)).collect())
    assert c.composed_rows(df, "x", ["id"], "y").filter("id = 3").first()["y"].startswith("é\n")
    html = df.select("id", F.concat(F.lit("<p>a<b> c"), "x", F.lit("</b></p><p>d</p>")).alias("h"))
    fields = {"all": "p", "b": "b", "none": "i"}
    assert sorted(pages.picked_rows(html, "h", ["id"], fields, ("all",), held_chars=40).collect()) == sorted(html.select("id", pages.pick(F.col("h"), fields, ("all",)).alias("f")).select("id", "f.*").collect())


def test_parts_of_a_table_grow_with_it(spark, tmp_path):
    from __spark_entry__ import queries

    spark.createDataFrame([(i, "t", "en", "a", i) for i in range(90)], "doc_id long, text string, lang string, source string, n_chars long").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # a partition of the reader has two files
    try:
        df = queries()["scan_glob"](spark, str(tmp_path))
        assert len(df.inputFiles()) > 4 and df.count() == 90
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
