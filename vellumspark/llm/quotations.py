"""Chat formatting: quotation linking and reply-ordered conversations without quotes.

Lines that begin with ``>`` marks are quotes, their number the level; adjoining
lines of one level are a passage; a line that ends in ``wrote:`` right before a
quote introduces it and goes with it.  A passage is normalised (lower case, one
space between words) and hashed whole, by paragraph and by line; so are the own
words of every message.  A passage links to the message whose own words have the
hash: the first such message of the same conversation if it is earlier, else the
first of all messages if that is earlier; whole passages count before
paragraphs, those before lines.  The passage of the lowest level that links, the
last one of these in the text, names the parent.

The index has one row for each hash (and for each conversation and hash), made
with partial aggregation, so a first turn that thousands share stays one row,
and a quoted one joins to it without a product.  Roots and depths come by pointer
doubling; a parent is always earlier, so there are no circles.

Defined results: null text counts as empty; empty own words are never linked to;
a message without a linked quote is a root of depth 0; messages are known by
(conv_id, turn), a null there makes a message that nothing links to; of repeated
keys each row gets the same parent, root and depth; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_groups, cut, drop_cut, hot_keys, spread_join, stored, table

MARKS = re.compile(r"^((?:[ \t]*>)+)[ \t]?")
WHOLE, PARAGRAPH, LINE = 0, 1, 2
PARSED = "conv_id long, turn long, role string, own_text string, own array<struct<unit:int,hash:binary>>, quotes array<struct<place:int,level:int,units:array<struct<unit:int,hash:binary>>>>, n_quotes int"


def passages(text: str) -> list[tuple[int, str]]:
    """(level, text) of runs of lines of one level, in order; level 0 is the message's own."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        level, rest = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if not out or out[-1][0] != level:
            if level > 0 and out and out[-1][0] < level and out[-1][1] and out[-1][1][-1].rstrip().endswith("wrote:"):
                out[-1][1].pop()
            out.append((level, []))
        out[-1][1].append(rest)
    return [(level, "\n".join(lines).strip("\n")) for level, lines in out]


def unit_hashes(text: str) -> list[tuple[int, bytes]]:
    """Distinct (unit, 16-byte hash) of the whole text, its paragraphs and its lines; a hash keeps its largest unit."""
    found: dict[bytes, int] = {}
    for unit, parts in ((WHOLE, [text]), (PARAGRAPH, re.split(r"\n[ \t]*\n", text)), (LINE, text.split("\n"))):
        for part in parts:
            if words := part.lower().split():
                found.setdefault(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest(), unit)
    return [(unit, h) for h, unit in found.items()]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_kind = pa.list_(pa.struct([("unit", pa.int32()), ("hash", pa.binary())]))
    quote_kind = pa.list_(pa.struct([("place", pa.int32()), ("level", pa.int32()), ("units", own_kind)]))
    for batch in batches:
        texts, own, quotes, n = [], [], [], []
        for text in batch.column("text").to_pylist():
            parts = passages(text or "")
            mine = "\n".join(p for level, p in parts if level == 0 and p.strip())
            texts.append(mine)
            own.append([{"unit": u, "hash": h} for u, h in unit_hashes(mine)])
            quoted = [(i, level, p) for i, (level, p) in enumerate(parts) if level]
            quotes.append([{"place": i, "level": level, "units": [{"unit": u, "hash": h} for u, h in unit_hashes(p)]} for i, level, p in quoted])
            n.append(len(quoted))
        arrays = [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(texts, pa.string()), pa.array(own, own_kind), pa.array(quotes, quote_kind), pa.array(n, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "role", "own_text", "own", "quotes", "n_quotes"])


def parse_messages(messages: DataFrame) -> DataFrame:
    role = F.col("role").cast("string") if "role" in messages.columns else F.lit(None).cast("string")
    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.col("text").cast("string").alias("text")).mapInArrow(_parse, PARSED)


def quote_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, n_linked): the parent of each message that has a linked quote."""
    keyed = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    units = keyed.select("conv_id", "turn", F.explode("own.hash").alias("hash"))
    here = cut(units.groupBy("conv_id", "hash").agg(F.min("turn").alias("first_turn")))
    anywhere = cut(here.groupBy("hash").agg(F.min(F.struct("conv_id", F.col("first_turn").alias("turn"))).alias("first")))
    places = keyed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").filter(F.size("units") > 0)
    # whole passages first; only those that link nowhere try their paragraphs and lines
    whole = places.select("conv_id", "turn", "place", "level", F.col("units")[0]["unit"].alias("unit"), F.col("units")[0]["hash"].alias("hash"), F.slice("units", 2, F.greatest(F.size("units") - 1, F.lit(1))).alias("rest"))
    first = cut(_targets(whole, here, anywhere))
    parts = first.filter("target IS NULL").select("conv_id", "turn", "place", "level", F.explode("rest").alias("u")).select("conv_id", "turn", "place", "level", "u.*")
    columns = ["conv_id", "turn", "place", "level", "unit", "target"]
    linked = first.select(*columns).unionByName(_targets(parts, here, anywhere).select(*columns)).filter("target IS NOT NULL")
    # the lowest level, then the last passage, then its largest unit
    best = F.min(F.struct("level", (-F.col("place")).alias("back"), "unit", "target"))
    links = cut(linked.groupBy("conv_id", "turn").agg(best["target"].alias("parent"), F.count_distinct("place").alias("n_linked")))
    for done in (here, anywhere, first):
        drop_cut(done)
    return links


def _targets(quotes: DataFrame, here: DataFrame, anywhere: DataFrame) -> DataFrame:
    """quotes with the message that each hash is found in, null if none is earlier: the first of the conversation, else the first of all."""
    quotes = cut(quotes)
    earlier = F.when(F.col("first_turn") < F.col("turn"), F.struct("conv_id", F.col("first_turn").alias("turn")))
    near = cut(spread_join(quotes, here, ["conv_id", "hash"], "left", hot_keys(quotes, ["conv_id", "hash"])).withColumn("near", earlier).drop("first_turn"))
    lone = near.filter("near IS NULL")
    far = spread_join(lone, anywhere, ["hash"], "left", hot_keys(lone, ["hash"]))
    far = far.withColumn("target", F.when(F.col("first") < F.struct("conv_id", "turn"), F.col("first"))).drop("near", "first")
    return near.filter("near IS NOT NULL").withColumnRenamed("near", "target").unionByName(far)


def roots(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, root, depth) of every linked message, by pointer doubling."""
    state = cut(links.select(F.struct("conv_id", "turn").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done")))
    for _ in range(most_rounds):
        if not state.filter(~F.col("done")).limit(1).count():
            return state.select("node.conv_id", "node.turn", F.col("up").alias("root"), "depth")
        over = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        left = state.filter(~F.col("done"))
        moved = spread_join(left, over, ["up"], "left", hot_keys(left, ["up"]))
        moved = moved.select("node", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNull().alias("done"))
        before, state = state, cut(state.filter("done").unionByName(moved))
        drop_cut(before)
    raise RuntimeError(f"replies are deeper than 2 ** {most_rounds}")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, parent_conv, parent_turn, root_conv, root_turn, depth, n_quotes, n_linked, text (own words)."""
    parsed = stored(parse_messages(messages), "messages")
    links = quote_links(parsed.select("conv_id", "turn", "own", "quotes"))
    told = cut(links.join(roots(links), ["conv_id", "turn"]))
    out = spread_join(parsed.select("conv_id", "turn", "role", "own_text", "n_quotes"), told, ["conv_id", "turn"], "left", hot_keys(parsed, ["conv_id", "turn"]))
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.col("parent.conv_id").alias("parent_conv"),
        F.col("parent.turn").alias("parent_turn"),
        F.coalesce("root.conv_id", "conv_id").alias("root_conv"),
        F.coalesce("root.turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("own_text").alias("text"),
    )


REPLY_ORDER = ["root_conv", "root_turn", "conv_id", "turn"]


def in_reply_order(linked: DataFrame) -> DataFrame:
    """The conversations without quotes: all messages sorted over partitions, each with its ``position`` (from 0) among those of its root.

    A message stands after its parent.  The rows are numbered over all
    partitions, so a thread may hold any share of them.  A message without
    conv_id or turn has position 0.
    """
    made = linked.repartitionByRange(*REPLY_ORDER, F.xxhash64("text")).sortWithinPartitions(*REPLY_ORDER).withColumn("at", F.monotonically_increasing_id())
    made = cut(made)  # numbers go up from partition to partition
    task = F.shiftright("at", 33)
    sizes = sorted((r["task"], r["n"]) for r in made.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, before = [], 0
    for number, n in sizes:
        starts.append((number, before))
        before += n
    offsets = F.broadcast(linked.sparkSession.createDataFrame(starts, "task long, offset long"))  # one row a partition
    told = made.withColumn("task", task).join(offsets, "task").withColumn("place", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1))
    keyed = told.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    first = keyed.groupBy("root_conv", "root_turn").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("messages"))
    placed = attach_groups(keyed, cut(first), ["root_conv", "root_turn"], "messages").withColumn("position", F.col("place") - F.col("first"))
    lost = told.filter("conv_id IS NULL OR turn IS NULL").withColumn("position", F.lit(0).cast("long"))
    return placed.select(*linked.columns, "position").unionByName(lost.select(*linked.columns, "position"))


def quoted_conversations(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: each message after the first quotes the one before (by turns its whole text, its first paragraph, its first line), and what that one quoted a level deeper."""
    whole = F.regexp_replace(F.coalesce("text", F.lit("")), "^\\n+|\\n+$", "")
    part = F.when(F.col("turn") % 3 == 0, whole).when(F.col("turn") % 3 == 1, F.element_at(F.split(whole, "\n[ \t]*\n"), 1)).otherwise(F.regexp_extract(whole, "^[^\\n]*", 0))
    none = F.lit(None).cast("string")
    to = F.explode(F.array(F.struct((F.col("turn") + 1).alias("turn"), part.alias("head"), none.alias("older")), F.struct((F.col("turn") + 2).alias("turn"), none.alias("head"), part.alias("older"))))
    heads = conversations.select("conv_id", to.alias("x")).select("conv_id", "x.*").groupBy("conv_id", "turn").agg(F.min("head").alias("head"), F.min("older").alias("older"))
    marked = lambda c, marks: F.concat(F.lit(marks), F.replace(c, F.lit("\n"), F.lit(f"\n{marks}")), F.lit("\n"))
    deep = F.when(F.coalesce("older", F.lit("")) != "", marked(F.col("older"), ">> ")).otherwise("")
    quoted = heads.filter("head != ''").select("conv_id", "turn", F.concat(F.lit("They wrote:\n"), deep, marked(F.col("head"), "> ")).alias("quoted"))
    return conversations.join(quoted, ["conv_id", "turn"], "left").withColumn("text", F.concat(F.coalesce("quoted", F.lit("")), F.coalesce("text", F.lit("")))).drop("quoted")


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations without their quotes, in reply order: sort by root_conv, root_turn, position."""
    return in_reply_order(link_quotations(quoted_conversations(table(spark, sf_dir, "conversations"))))
