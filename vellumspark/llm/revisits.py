"""WARC: resolution of not-modified revisits.

An as-of join by canonical URL: each revisit record meets the latest full
response of its URL with an earlier time.  The validators are then checked (weak
comparison of entity tags; where either side has none, the modification dates)
and the permitted headers of the revisit replace those of the response.

The join is two window functions, not a range join: rows get a time block (equal
shares of all rows), the latest response inside the row's (URL, block) comes from
one window, that of earlier blocks from a second window over one summary row for
each (URL, block).  A URL that holds any share of all rows is thus spread over
all blocks; only records of one URL and one instant stay together.

Defined results: a null URL or time, or no earlier full response, gives
``no_original``; no validator on both sides gives ``no_validator``; different
ones ``mismatch``; else ``resolved``.  Of responses at one instant the one with
the largest record id is later; a response at the instant of the revisit is not
earlier.  Null headers count as none, names are compared in lower case, of
repeated names the last holds.  Repeated revisit rows are resolved each; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Header fields that a not-modified response must not change (RFC 9110 and 9111).
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that do not change what a page shows.
TRACKING = "^(?:utm_[a-z]+|fbclid|gclid|ref|sessionid)(?:=|$)"
BLOCKS = 256


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. and default port, path without trailing slash, sorted parameters without tracking, no scheme or fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^(?i:https?://)", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def merge_headers(old: Column, new: Column) -> Column:
    """Headers of the response, with the permitted ones of the revisit in place of theirs."""
    old, new = _lowered(old), F.map_filter(_lowered(new), lambda k, _: ~k.isin(KEPT_HEADERS))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def _bounds_up_to(value: Column, bounds: list[float], first: int = 0) -> Column:
    """How many of the sorted bounds are not over the value, by binary search."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(value < bounds[half], _bounds_up_to(value, bounds[:half], first)).otherwise(_bounds_up_to(value, bounds[half + 1 :], first + half + 1))


def resolve_revisits(captures: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row for each revisit.

    captures: record_id, url, ts (long or timestamp), is_revisit boolean, etag,
    last_modified (strings), headers map<string,string>, payload_digest string.
    """
    rows = captures.select("record_id", "url", canonical_url(F.col("url")).alias("canon"), F.col("ts").cast("double").alias("at"), "ts", F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"), "etag", "last_modified", "headers", "payload_digest")
    shares = [i / blocks for i in range(1, blocks)]
    bounds = sorted(set(rows.agg(F.percentile_approx("at", shares, 10_000)).first()[0] or []))
    rows = rows.withColumn("block", _bounds_up_to(F.col("at"), bounds))
    usable = F.col("canon").isNotNull() & F.col("at").isNotNull()
    full = F.struct("at", "ts", "record_id", "etag", "last_modified", "headers", "payload_digest")
    known = rows.filter(usable)
    inside = Window.partitionBy("canon", "block").orderBy("at", F.col("is_revisit").desc(), "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = known.withColumn("near", F.last(F.when(~F.col("is_revisit"), full), ignorenulls=True).over(inside)).filter("is_revisit")
    last = known.groupBy("canon", "block").agg(F.max_by(F.when(~F.col("is_revisit"), full), F.when(~F.col("is_revisit"), F.struct("at", "record_id"))).alias("last"))
    before = Window.partitionBy("canon").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("canon", "block", F.last("last", ignorenulls=True).over(before).alias("far"))
    joined = placed.join(carried, ["canon", "block"], "left").withColumn("original", F.coalesce("near", "far"))
    lost = rows.filter(F.col("is_revisit") & ~F.coalesce(usable, F.lit(False))).withColumn("original", F.lit(None).cast(joined.schema["original"].dataType))
    joined = joined.select(*rows.columns, "original").unionByName(lost.select(*rows.columns, "original"))
    tag = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    same_tag = tag(F.col("etag")) == tag(F.col("original.etag"))
    same_date = F.trim("last_modified") == F.trim("original.last_modified")
    same = F.coalesce(same_tag, same_date)
    status = F.when(F.col("original").isNull(), "no_original").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    joined = joined.withColumn("resolution", status)
    ok = F.col("resolution") == "resolved"
    return joined.select(
        "record_id",
        "url",
        F.col("canon").alias("canonical_url"),
        "ts",
        "resolution",
        F.col("original.record_id").alias("original_id"),
        F.col("original.ts").alias("original_ts"),
        F.when(ok, merge_headers(F.col("original.headers"), F.col("headers"))).alias("headers"),
        F.when(ok, F.col("original.payload_digest")).alias("payload_digest"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Every page as a full response, every fifth captured again later, and a revisit of each.

    By number, revisits name another version, name none but a date, name nothing
    that the response has too, or come before every response.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    page = F.col("page_id").cast("long")
    day = F.when(page % 3 != 0, F.concat(F.lit("day "), (page % 4).cast("string")))
    early = page % 17 == 5
    tag = F.when(page % 11 != 3, digest)
    seen = F.when(page % 7 == 0, F.lit("other")).when(~(page % 11).isin(3, 4), F.concat(F.lit("W/"), digest))
    kind = lambda n, at, revisit, etag, when: F.struct((page * 4 + n).alias("record_id"), at.alias("ts"), F.lit(revisit).alias("is_revisit"), etag.alias("etag"), F.lit(when).alias("date"))
    kinds = F.array(
        kind(0, page * 4, False, tag, "first"),
        F.when(page % 5 == 0, kind(2, page * 4 + 401, False, tag, "again")),
        kind(1, F.when(early, -1 - page * 4).otherwise(page * 4 + 2003), True, seen, "later"),
    )
    rows = pages.select("url", page.cast("string").alias("page"), digest.alias("digest"), day.alias("day"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    own = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.col("k.date"), F.lit("ETag"), F.col("digest"), F.lit("X-Page"), F.col("page"))
    sent = F.create_map(F.lit("Content-Type"), F.lit("none"), F.lit("Date"), F.col("k.date"), F.lit("etag"), F.col("digest"))
    return rows.select(
        "k.record_id",
        "url",
        "k.ts",
        "k.is_revisit",
        "k.etag",
        F.col("day").alias("last_modified"),
        F.when(F.col("k.is_revisit"), sent).otherwise(own).alias("headers"),
        F.when(~F.col("k.is_revisit"), F.col("digest")).alias("payload_digest"),
    )


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select("record_id", "canonical_url", "ts", "resolution", "original_id", "original_ts", F.array_join(lines, "\n").alias("headers"), "payload_digest")


ORACLE = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?://)', '') AS bare FROM pages),
c AS (
  SELECT page_id, digest,
         regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^www\.|:(?:80|443)$', '', 'g')
         || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
         || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canon
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
               lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|fbclid|gclid|ref|sessionid)(?:=|$)'))) AS q FROM p)),
d AS (SELECT *, CASE WHEN page_id % 3 <> 0 THEN 'day ' || page_id % 4 END AS day, CASE WHEN page_id % 11 <> 3 THEN digest END AS tag FROM c),
r AS (SELECT page_id * 4 AS record_id, page_id * 4 AS ts, * FROM d UNION ALL SELECT page_id * 4 + 2, page_id * 4 + 401, * FROM d WHERE page_id % 5 = 0),
v AS (SELECT page_id * 4 + 1 AS record_id, canon, CASE WHEN page_id % 17 = 5 THEN -1 - page_id * 4 ELSE page_id * 4 + 2003 END AS ts, digest, day,
             CASE WHEN page_id % 7 = 0 THEN 'other' WHEN page_id % 11 NOT IN (3, 4) THEN digest END AS etag FROM d),
j AS (SELECT v.*, o.record_id AS original_id, o.ts AS original_ts, o.digest AS original_digest, o.page_id AS original_page, coalesce(v.etag = o.tag, v.day = o.day) AS same
      FROM v ASOF LEFT JOIN r o ON v.canon = o.canon AND v.ts > o.ts)
SELECT record_id, canon AS canonical_url, ts,
       CASE WHEN original_id IS NULL THEN 'no_original' WHEN same IS NULL THEN 'no_validator' WHEN same THEN 'resolved' ELSE 'mismatch' END AS resolution,
       original_id, original_ts,
       CASE WHEN same THEN 'content-type: text/html' || chr(10) || 'date: later' || chr(10) || 'etag: ' || digest || chr(10) || 'x-page: ' || original_page END AS headers,
       CASE WHEN same THEN original_digest END AS payload_digest
FROM j
"""
