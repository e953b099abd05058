import random

import pytest
from pyspark.sql import functions as F

from vellumspark.llm.revisits import KEPT_HEADERS, canonical_url, op1_warc_revisits, page_captures, resolve_revisits

CAPTURES = "record_id long, url string, ts long, is_revisit boolean, etag string, last_modified string, headers map<string,string>, payload_digest string"


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://WWW.Example.com:80/A/b/?b=2&a=1#x", "example.com/A/b?a=1&b=2"),
        ("https://example.com", "example.com"),
        ("https://example.com/?utm_source=feed&ref=x", "example.com"),
        ("example.com/p?reference=1", "example.com/p?reference=1"),
        (None, None),
        ("", ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u"))).first()[0] == want


def brute(rows):
    out = []
    for rid, url, ts, revisit, etag, date, headers, _ in rows:
        if not revisit:
            continue
        earlier = [r for r in rows if not r[3] and url and r[1] == url and ts is not None and r[2] is not None and r[2] < ts]
        best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        if best is None:
            out.append((rid, "no_original", None, None))
            continue
        tag = lambda x: None if x is None else x.strip().removeprefix("W/")
        pairs = [(tag(etag), tag(best[4])), (date, best[5])]
        same = next((a == b for a, b in pairs if a is not None and b is not None), None)
        state = "no_validator" if same is None else "resolved" if same else "mismatch"
        merged = None
        if same:
            low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
            merged = low(best[6]) | {k: v for k, v in low(headers).items() if k not in KEPT_HEADERS}
        out.append((rid, state, best[0], merged))
    return sorted(out, key=str)


def random_rows(n=400):
    rng = random.Random(4)
    pick = lambda *x: rng.choice(x)
    return [
        (i, pick("a.com/hot", "a.com/hot", "b.org/x", None, f"c.net/{i % 9}"), pick(None, *range(60)), rng.random() < 0.5, pick("1", "W/1", "2", None), pick("Mon", "Tue", None),
         pick(None, {}, {"Date": str(i)}, {"ETag": "n", "Content-Type": "t", "X": str(i)}), None)
        for i in range(n)
    ]


@pytest.mark.parametrize("blocks", [1, 4, 64])
def test_equals_brute_force(spark, blocks):
    rows = random_rows()
    df = spark.createDataFrame(rows, CAPTURES).withColumns({c: F.lit("clash") for c in ("block", "near", "far", "canon", "original")})
    got = resolve_revisits(df.repartition(5), blocks=blocks).collect()
    assert sorted(((r["record_id"], r["resolution"], r["original_id"], r["headers"]) for r in got), key=str) == brute(rows)


def test_repeated_rows_empty_tables_and_repeated_header_names(spark):
    rows = [(1, "u/", 1, False, "e", None, None, "d"), *[(2, "u", 5, True, "e", None, None, None)] * 2]
    headers = F.expr("IF(record_id = 1, map('A', '1', 'a', '2'), map('B', 'x', 'b', 'y'))")
    got = resolve_revisits(spark.createDataFrame(rows, CAPTURES).withColumn("headers", headers)).collect()
    assert [(r["original_id"], r["headers"], r["payload_digest"]) for r in got] == [(1, {"a": "2", "b": "y"}, "d")] * 2
    assert resolve_revisits(spark.createDataFrame([], CAPTURES)).count() == 0


def test_query_covers_every_page(spark, tmp_path):
    html = ["one", "two", None]
    rows = [(i, f"http://{'www.' if i % 2 else ''}a.com/{i % 6}", html[i % 3]) for i in range(700)] + [(9000, None, "three")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    made = [tuple(r) for r in page_captures(pages).collect()]
    assert len(made) == 2 * 701 + 141
    canon = [(r[0], None if r[1] is None else r[1].replace("http://", "").replace("www.", ""), *r[2:]) for r in made]
    want = {r[0]: r for r in brute(canon)}
    got = op1_warc_revisits(spark, str(tmp_path)).collect()
    assert len(got) == 701 and {r["resolution"] for r in got} == {"resolved", "mismatch", "no_validator", "no_original"}
    for r in got:
        _, state, original, headers = want[r["record_id"]]
        lines = None if headers is None else "\n".join(f"{k}: {v}" for k, v in sorted(headers.items()))
        assert (r["resolution"], r["original_id"], r["headers"]) == (state, original, lines)
