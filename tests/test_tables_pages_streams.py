import datetime as dt
import random
import shutil
from collections import Counter

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vellumspark.operators import pages, tables
from vellumspark.sources import io
from vellumspark.streaming import jobs


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_bookkeeping(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), (None, 3, "z")], "k string, n int, v string")
    assert rows(tables.keep_first(df, ["k"], ["n"]), "k", "n", "v") == [("a", 1, "y"), ("b", 1, None), (None, 3, "z")]
    assert rows(tables.remaining(df, df.filter("k = 'a'"), "k"), "k") == [("b",), (None,)]
    new = spark.createDataFrame([("a", 2, "new"), ("c", 0, "new")], "k string, n int, v string")
    assert rows(tables.upsert(df.filter("k IS NOT NULL"), new, "k", "n"), "k", "v") == [("a", "new"), ("b", None), ("c", "new")]
    assert tables.insert_or_ignore(df, new, "k").count() == 5
    assert rows(tables.duplicates(df, ["k"]), "k", "n") == [("a", 2)]
    assert rows(tables.batch_numbers(df.filter("k = 'a'"), "n", 1, "k"), "n", "batch") == [(1, 0), (2, 1)]
    assert tables.accuracy(spark.createDataFrame([("1", "A "), ("2", "B")], "qid string, answer string"), spark.createDataFrame([("1", "A"), ("2", "C"), ("3", "D")], "qid string, answer string")).first() == (2, 1, 50.0)


def test_columns_of_any_name_survive(spark):
    df = spark.createDataFrame([("a", 1, "x", "y", "z", "d", "e")], "k string, n int, new string, _new string, row string, done string, _done string")
    both = tables.upsert(df, df.withColumn("n", F.lit(2)), "k", "n")
    assert both.columns == df.columns and both.first() == ("a", 2, "x", "y", "z", "d", "e")
    assert tables.remaining(df, df.filter("n = 9"), "k").columns == df.columns and tables.remaining(df, df, "k").count() == 0


def test_seeds_of_a_large_table(spark):
    many = spark.range(10_500).select(F.col("id").cast("string").alias("x"))
    assert io.seeds(spark, many.union(many)).count() == 10_500


def test_pages(spark):
    html = '<html><head><title>T</title><style>x</style><meta name="date" content="2020"></head><body><nav><a href="/menu">menu</a></nav><div class="ad">buy</div><p>' + "Real text. " * 30 + '<p>more<br>line</p><a href="b/c">l</a><a href="//o.net/z">o</a><a href="#x">no</a><a href="mailto:a@b">m</a></body>'
    df = spark.createDataFrame([("http://a.com/d/p?q=1", html), ("http://e.org", None)], "url string, html string")
    got = df.select("url", pages.main_content(F.col("html")).alias("m")).collect()
    assert got[0]["m"]["title"] == "T" and "Real text." in got[0]["m"]["text"] and "buy" not in got[0]["m"]["text"] and got[1]["m"]["text"] == ""
    assert rows(pages.links(df), "link") == [("http://a.com/d/b/c",), ("http://a.com/menu",), ("http://o.net/z",)]
    assert df.select(pages.scrape(F.col("html"), ["date"]).alias("s")).first()["s"]["date"] == "2020"
    assert spark.range(1).select(pages.page_urls(F.lit("u"), 3, 10)).first()[0] == ["u?page=0", "u?page=10", "u?page=20"]
    found = spark.createDataFrame([("http://a.com/list/long-document-name-1",), ("http://a.com/list/x",), ("http://b.com/list/long-document-name-1",)], "link string")
    assert pages.document_links(found, "http://a.com/list/").count() == 1


def cut_pages(spark, folder):
    """Pages whose titles and texts end inside a reference, as a folder of files."""
    body = "<h1>A &amp; B</h1><p>" + "Real text. " * 30 + "</p>"
    texts = ["A &amp; B", "A &amp", "say &quot;x&quot", "A &#38", "end &am", "&nbsp middle &amp;lt; x"]
    pages_ = [(i, f"http://a.com/{i}", f"<html><head><title>{x}</title></head><body><article>{body}<p>{x}</p></article></body></html>") for i, x in enumerate(texts)]
    spark.createDataFrame(pages_, "page_id long, url string, html string").repartition(2).write.parquet(f"{folder}/pages.parquet")
    return f"{folder}"


def same_as_sql(spark, folder, name, table):
    from __spark_entry__ import oracle_sql, queries

    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = queries()[name](spark, folder)
    wanted = db.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()[name]})").fetchall()
    return Counter(tuple(r) for r in df.collect()) == Counter(wanted)


@pytest.mark.parametrize("name", ["main_content", "content_in_layout"])
def test_texts_that_end_inside_a_reference(spark, tmp_path, name):
    folder = cut_pages(spark, tmp_path)
    spark.read.parquet(f"{folder}/pages.parquet").filter("page_id IN (0, 1, 4)").write.parquet(f"{folder}/some/pages.parquet")
    assert same_as_sql(spark, f"{folder}/some", name, "pages")
    read = spark.read.parquet(f"{folder}/pages.parquet").orderBy("page_id").select(pages.main_content(F.col("html"), 1).alias("m"))
    assert [r["m"]["text"].split("\n")[-1] for r in read.collect()] == ["A & B", "A &amp", 'say "x&quot', "A &#38", "end &am", "middle &lt; x"]


def test_scraped_titles_with_references(spark, tmp_path):
    assert same_as_sql(spark, cut_pages(spark, tmp_path), "scraped_fields", "pages")


def page_of(words, rng):
    """A page in one of many layouts, and its content lines: paragraphs, headings, short lists and a table in the text; links, teasers and bars around and in it."""
    take = lambda n: " ".join(rng.choice(words) for _ in range(n))
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{i}">{take(rng.randint(2, 14))}</a>' for i in range(n)) + "</ul>"
    bar = "<div>" + "".join(f"<span><i></i>{x}</span>" for x in ("Mail", "Pin", "Like", "Say")) + "</div>"
    lines, inner = [], []
    for i in range(rng.randint(3, 12)):
        kind = rng.choice(["p", "p", "p", "h2", "li", "td", "div"])
        some = [take(rng.randint(12, 90) if kind in ("p", "div") else rng.randint(2, 6)) for _ in range(rng.randint(2, 5) if kind in ("li", "td") else 1)]
        lines += some
        inner.append({"li": "<ul>" + "".join(f"<li>{x}" for x in some) + "</ul>", "td": "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in some) + "</table>"}.get(kind, f"<{kind}>{some[0]}</{kind}>"))
        if i % 4 == 1:
            inner.append(rng.choice([links(4), bar, f'<div><h4>Related</h4>{links(3)}</div>']))
    inner.insert(0, "<p>" + (first := take(120)) + "</p>")
    body, shell = "".join(inner), rng.choice(["article", "div", "section", "td"])
    body = f"<table><tr><td>{links(6)}</td><td>{bar}{body}</td></tr></table>" if shell == "td" else f"<{shell}>{body}</{shell}>"
    return f"<html><title>t</title><body><div>{links(12)}</div><div><div>{body}</div><div>{links(9)}<p>{take(8)}</p></div></div><div>{take(5)}</div></body></html>", [first, *lines]


def test_main_content_over_the_element_tree(spark):
    rng = random.Random(5)
    made = [page_of([f"word{i}" for i in range(400)], rng) for _ in range(120)]
    df = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(made)], "i int, html string")
    got = {r["i"]: r["text"].split("\n") for r in df.select("i", pages.main_content(F.col("html"))["text"].alias("text")).collect()}
    right = found = known = 0
    for i, (_, lines) in enumerate(made):
        want, have = Counter(lines), Counter(got[i])
        right += sum(len(x) * n for x, n in (want & have).items())
        found += sum(len(x) * n for x, n in have.items())
        known += sum(len(x) * n for x, n in want.items())
    assert right / found > 0.97 and right / known > 0.97, (right / found, right / known)


def test_main_content_of_odd_pages():
    assert pages.main_lines(None) == pages.main_lines("") == ("", [])
    assert pages.main_lines("<h1>A  b</h1>text")[0] == "A b" and pages.main_lines("<p>one<p>two<div>three") == ("", ["one", "two", "three"])
    assert pages.main_lines("</div></p>loose<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")[1] == ["loose", "a", "b", "c", "d"]
    deep = "<div>" * 5000 + "x" * 300 + "</div>" * 5000
    assert pages.main_lines(deep)[1] == ["x" * 300]
    only_links = '<ul><li><a href="/a">' + "a link " * 60 + "</a></ul>"
    assert len(pages.main_lines(only_links)[1]) == 1  # nothing else is there: all lines


def test_fields_by_selector(spark):
    html = '<div class="a b" id="top"><p>one <b>two</b><p>three<ul><li>x<li>y</ul></div><div class="a"><p>four</p></div><img src="i"><span>tail &amp; end</span>'
    fields = {"first": "p", "all": ".a.b p", "nested": "div#top b", "items": "ul li", "tail": "span", "none": "div.c p", "deep": "div ul .z"}
    df = spark.createDataFrame([(html,), (None,), ("<p>open",)], "html string")
    got = [tuple(r["f"]) for r in df.select(pages.pick(F.col("html"), fields, joined=("all", "items")).alias("f")).collect()]
    assert got == [("one two", "one two three", "two", "x y", "tail & end", "", ""), ("",) * 7, ("open", "", "", "", "", "", "")]


def test_traverse(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("z", "c"), ("d", "e"), ("b", "a")], "src string, dst string")
    got = rows(pages.traverse(io.seeds(spark, ["a", "z", "a"]), edges, 2), "node", "level", "origin")
    assert got == [("a", 0, "a"), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "a"), ("z", 0, "z")]
    chain = spark.range(40).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    deep = pages.traverse(io.seeds(spark, ["0"]), chain, 12)
    assert deep.count() == 13 and deep.agg(F.max("level")).first()[0] == 12
    assert len(deep._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert pages.traverse(io.seeds(spark, ["38"]), chain, 1000).count() == 3  # ends where nothing is new


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "A"), ("2", "B")], "qid string, answer string")
    io.write_results(df, f"{tmp_path}/csv")
    assert rows(io.read_results(spark, f"{tmp_path}/csv"), "qid", "answer") == [("1", "A"), ("2", "B")]
    io.write_json_lines(df, f"{tmp_path}/json")
    assert io.read_json_lines(spark, f"{tmp_path}/json").count() == 2
    (tmp_path / "array.json").write_text('[{"qid": "1"}, {"qid": "2"}]')
    assert io.read_json_array(spark, f"{tmp_path}/array.json").count() == 2
    (tmp_path / "lines.txt").write_text(" a \n\nb\n")
    assert rows(io.read_lines(spark, f"{tmp_path}/lines.txt"), "line") == [("a",), ("b",)]
    (tmp_path / "bom.txt").write_text("﻿whole\ntext", encoding="utf-8")
    assert io.read_whole_texts(spark, f"{tmp_path}/bom.txt").first()["text"] == "whole\ntext"
    io.write_parquet(df.coalesce(1), f"{tmp_path}/pq", rows_per_file=1)
    (tmp_path / "pq" / "bad.parquet").write_bytes(b"junk")
    assert io.read_parquet(spark, f"{tmp_path}/pq", "qid string, answer string", ["qid"], skip_bad=True).count() == 2
    assert [r["path"].rsplit("/", 1)[-1] for r in io.silent_files(spark, f"{tmp_path}/pq", "qid string, answer string").collect()] == ["bad.parquet"]
    io.replace_table(io.read_results(spark, f"{tmp_path}/csv").limit(1), f"{tmp_path}/csv2", f"{tmp_path}/staging")
    assert spark.read.parquet(f"{tmp_path}/csv2").count() == 1


def test_streams(spark, tmp_path):
    docs = lambda ids: spark.createDataFrame([(i, f"Sentence number {i}. " * 20, "en", "s", 0) for i in ids], jobs.DOCUMENTS)
    source = f"{tmp_path}/in"
    for ids in (range(3), range(3, 5)):
        docs(ids).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.source(spark, source, "*.parquet", jobs.DOCUMENTS)
        jobs.chunk_stream(stream, f"{tmp_path}/chunks", f"{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/chunks").select("doc_title").distinct().count() == max(ids) + 1
    changed = docs([1]).withColumns({"n_chars": F.lit(9).cast("long"), "source": F.lit("new")})
    for batch in (docs(range(3)), changed):
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/up")
        stream = jobs.source(spark, f"{tmp_path}/up", "*.parquet", jobs.DOCUMENTS)
        jobs.upsert_stream(stream, f"{tmp_path}/table", f"{tmp_path}/upstate", "doc_id", "n_chars").awaitTermination()
    assert rows(jobs.upserted(spark, f"{tmp_path}/table"), "doc_id", "source") == [(0, "s"), (1, "new"), (2, "s")]


@pytest.mark.parametrize("name", ["stream_upsert", "stream_event_windows"])
def test_a_stream_reads_a_table_of_one_file_or_of_a_folder(spark, tmp_path, name):
    from __spark_entry__ import queries

    docs = spark.createDataFrame([(i, "t", "en", f"src{i % 3}", i) for i in range(9)], jobs.DOCUMENTS)
    events = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i), 1, "t", 1.0, "{}") for i in range(3)], jobs.EVENTS)
    for table, df in (("documents", docs), ("events", events)):
        df.repartition(2).write.parquet(f"{tmp_path}/parts/{table}.parquet")
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}")
        shutil.copy(next((tmp_path / table).glob("*.parquet")), tmp_path / f"{table}.parquet")
    got = [sorted(queries()[name](spark, folder).collect()) for folder in (f"{tmp_path}/parts", str(tmp_path))]
    assert got[0] == got[1] and len(got[0]) == 3


def test_a_damaged_version_is_an_error(spark, tmp_path):
    docs = lambda ids: spark.createDataFrame([(i, "t", "en", "s", i) for i in ids], jobs.DOCUMENTS)
    run = lambda: jobs.upsert_stream(jobs.source(spark, f"{tmp_path}/up", "*.parquet", jobs.DOCUMENTS), f"{tmp_path}/table", f"{tmp_path}/state", "doc_id", "n_chars").awaitTermination()
    docs([1, 2]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/up")
    run()
    files = list((tmp_path / "table").glob("bucket=*/*.parquet"))
    for file in files:
        file.write_bytes(b"damaged")
    docs([1, 2, 3]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/up")
    with pytest.raises(StreamingQueryException):
        run()
    assert all(file.read_bytes() == b"damaged" for file in files)


def test_a_batch_that_failed_between_its_writes_is_finished(spark, tmp_path):
    docs = lambda ids, source: spark.createDataFrame([(i, "t", "en", source, i) for i in ids], jobs.DOCUMENTS)
    run = lambda: jobs.upsert_stream(jobs.source(spark, f"{tmp_path}/up", "*.parquet", jobs.DOCUMENTS), f"{tmp_path}/table", f"{tmp_path}/state", "doc_id", "n_chars").awaitTermination()
    docs(range(20), "old").coalesce(1).write.mode("append").parquet(f"{tmp_path}/up")
    run()
    docs(range(10), "new").coalesce(1).write.mode("append").parquet(f"{tmp_path}/up")
    run()
    # as if the second batch had been cut off while the table's buckets were replaced: its mark of completion and a bucket are gone
    for mark in (tmp_path / "state" / "state" / "commits").glob("*1*"):
        mark.unlink()
    lost = next(p for p in (tmp_path / "table").glob("bucket=*") if p.name in {x.name for x in (tmp_path / "state" / "merged" / "n=1").iterdir()})
    shutil.rmtree(lost)
    run()
    assert rows(jobs.upserted(spark, f"{tmp_path}/table"), "doc_id", "source") == sorted([(i, "new" if i < 10 else "old") for i in range(20)], key=str)


def test_windows(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    events = spark.createDataFrame([(i, at(m), u, "t", 1.0, "{}") for i, (m, u) in enumerate([(0, 1), (20, 1), (59, 1), (60, 2)])], jobs.EVENTS)
    assert sorted(r["n"] for r in jobs.window_counts(events).collect()) == [1, 3]
    assert sorted((r["user_id"], r["n"]) for r in jobs.sessions(events).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_bookkeeping_reads_all_documents(spark, tmp_path):
    from vellumspark.plans.catalog import QUERIES

    rows = [(i, ["en", "es", None][i % 3], "a", i) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["state_upsert"](spark, str(tmp_path)).select("doc_id", "source").collect()}
    assert got == {(i, "a" if i % 2 else "new") for i in range(12)}
    got = sorted((tuple(r) for r in QUERIES["insert_ignore"](spark, str(tmp_path)).select("doc_id", "lang").collect()), key=lambda r: r[0])
    assert got == [(-1 - i, "new") for i in (11, 9, 7, 5, 3, 1)] + [(r[0], r[1]) for r in rows]
