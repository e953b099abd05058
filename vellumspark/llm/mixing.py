"""Mixing sources to target weights: min-cost flow for overlapping sources.

Documents are aggregated by membership pattern (the sorted set of sources that
hold them) to token counts.  A small network then routes tokens: from the start
to each pattern arcs for one use after the other, each with the pattern's tokens
as its capacity and a cost that rises with the use (convex, so a first use comes
before any repeat); from a pattern to each of its sources; from a source to the
end its quota.  The flow is a maximum flow of least cost, so that a source that
can be filled from documents of its own leaves the shared ones to the others.

``source_mix`` takes memberships from the texts: a text that stands in documents
of several sources belongs to all of them, and each use of it counts, whichever
source it is for.  Sources that share a pattern take different stretches of its
texts, in the order of a seeded hash, before any text is used twice.

What a group (a pattern, or a pattern in one source) takes is some whole passes
and a part of one more; that part goes to texts in the order of the hash, by
cumulative size, and the text at which it ends gives the words still missing,
shared out evenly among its copies.  The end is found from sums over 1,024 ranges
of the hash at a time, until a range has few texts, then over these, so one group
may hold any share of all rows, and one text any share of a group.

The network has a node for each pattern and source, never for a document: at most
MOST_PATTERNS of them.  Its flow is found one cost after the other by blocking
flows, which takes seconds at that number.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are never taken; repeated rows count once
each; an empty table gives an empty result.  Rows keep all their other columns,
whatever their names; those that are added replace columns of the same name.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, table, word_count

#: Patterns and sources are planned on the driver; more than this many is an error, not a silent cut.
MOST_PATTERNS = 100_000
#: Bits of the hash that order texts, and those that one step of the search for the end reads.
BITS, STEP = 60, 10
PLAN = "grp string, shift long, passes long, part long"


def targets(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Quota of each source: share of all tokens by weight, at most ``most`` times its size, excess reshared by weight."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        per = total / sum(weight[k] for k in open_)
        over = [k for k in open_ if weight[k] * per > most * sizes[k]]
        if not over:
            return out | {k: weight[k] * per for k in open_}
        for k in over:
            out[k] = float(most * sizes[k])
            total -= out[k]
            open_.remove(k)
    return out


class Network:
    """Whole-number flows by blocking flows (Dinic)."""

    def __init__(self, nodes: int):
        self.at: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, capacity: int) -> int:
        """The arc's number; its reverse has the next one."""
        for x, y, r in ((a, b, capacity), (b, a, 0)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, start: int, end: int) -> list[int] | None:
        level, queue = [-1] * len(self.at), deque([start])
        level[start] = 0
        while queue:
            u = queue.popleft()
            for e in self.at[u]:
                if self.room[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level if level[end] >= 0 else None

    def fill(self, start: int, end: int) -> None:
        """Adds to the flow until it is a maximum."""
        while (level := self._levels(start, end)) is not None:
            turn, path, u = [0] * len(self.at), [], start
            while True:
                if u == end:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    first = next(i for i, e in enumerate(path) if not self.room[e])
                    u = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                while turn[u] < len(self.at[u]):
                    e = self.at[u][turn[u]]
                    if self.room[e] > 0 and level[self.to[e]] == level[u] + 1:
                        break
                    turn[u] += 1
                else:
                    if u == start:
                        break
                    u = self.to[path.pop() ^ 1]
                    turn[u] += 1
                    continue
                path.append(e)
                u = self.to[e]


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0): a maximum flow of least cost. All in whole numbers; only arcs out of start may have a cost.

    With such costs the flows out of start form a polymatroid, in which greed is
    optimal: arcs join in order of cost, and the flow on those before stays.
    """
    if any(c and a != start for a, _, _, c in arcs):
        raise ValueError("only arcs out of start may have a cost")
    net, place, paid = Network(n), [0] * len(arcs), {}
    for i, (a, b, capacity, c) in enumerate(arcs):
        place[i] = net.arc(a, b, 0 if a == start else capacity)
        if a == start:
            paid.setdefault(c, []).append(i)
    for c in sorted(paid):
        for i in paid[c]:
            net.room[place[i]] = arcs[i][2]
        net.fill(start, end)
    return [net.room[p + 1] for p in place]


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = 2, rooms: list[dict] | None = None) -> list[dict]:
    """For each pattern (sources, tokens): tokens sent to each of its sources; quotas are rounded.

    The r-th use of a token costs r squared; from the eighth on, uses come in
    blocks of 8, 16, ... at one cost.  rooms: for each pattern the most that each
    source may take of it, without them ``repeats`` times its tokens.
    """
    names = list(quotas)
    place = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    arcs, kept = [], []
    for i, (members, tokens) in enumerate(patterns):
        room = {s: repeats * tokens if rooms is None else rooms[i].get(s, 0) for s in members if s in place}
        left = repeats * tokens if rooms is None else sum(room.values())
        use, block = 0, 1
        while left > 0 and tokens > 0:
            arcs.append((0, 1 + i, min(left, block * tokens), use * use))
            left -= block * tokens
            use += block
            block = use if use >= 8 else 1
        for s, most in room.items():
            kept.append((len(arcs), i, s))
            arcs.append((1 + i, place[s], most, 0))
    arcs += [(place[s], end, round(quotas[s]), 0) for s in names]
    flow = min_cost_flow(end + 1, arcs, 0, end)
    out: list[dict] = [{} for _ in patterns]
    for arc, i, s in kept:
        if flow[arc] > 0:
            out[i][s] = flow[arc]
    return out


def _hash(*columns: Column) -> Column:
    """A whole number of BITS bits."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << BITS) - 1))


def _split_plan(taken: int, tokens: int) -> tuple[int, int]:
    return divmod(taken, tokens) if tokens else (0, 0)


def _ends(texts: DataFrame, plan: DataFrame, number: int) -> DataFrame:
    """(grp, end_place, share): where each group's part ends, and the words that each row there gives.

    texts: grp, place (BITS bits), size, n (rows), about ``number`` rows; those of one place in a group are equally large.
    """
    steps = min(BITS // STEP - 1, max(0, math.ceil((number.bit_length() - 13) / STEP)))  # about 8,000 texts are left to the last step
    at = F.broadcast(plan.filter("part > 0").select("grp", F.col("part").alias("left"), F.lit(0).cast("long").alias("prefix")))  # one row a group
    for step in range(1, steps + 1):
        inside = texts.join(at, "grp").filter(F.shiftright("place", BITS - STEP * (step - 1)) == F.col("prefix"))
        sums = inside.groupBy("grp", F.shiftright("place", BITS - STEP * step).alias("to")).agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.first("left").alias("left"))
        at = F.broadcast(cut(_at_end(sums, "to", "tokens").select("grp", "left", F.col("to").alias("prefix"))))
    inside = texts.join(at, "grp").filter(F.shiftright("place", BITS - STEP * steps) == F.col("prefix"))
    sums = inside.groupBy("grp", "place").agg(F.max("size").alias("size"), F.sum("n").alias("n"), F.first("left").alias("left"))
    last = _at_end(sums.withColumn("tokens", F.col("size") * F.col("n")), "place", "tokens")
    return cut(last.select("grp", F.col("place").alias("end_place"), F.expr("left div n").alias("share")))


def _at_end(sums: DataFrame, order: str, tokens: str) -> DataFrame:
    """Of each group the row in which ``left`` tokens end, with what is left for it."""
    before = F.coalesce(F.sum(tokens).over(Window.partitionBy("grp").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("before", before).filter((F.col("before") < F.col("left")) & (F.col("before") + F.col(tokens) >= F.col("left"))).withColumn("left", F.col("left") - F.col("before"))


def _taken(size: Column, place: Column, plan: Column) -> Column:
    extra = F.when(place < plan["end_place"], size).when(place == plan["end_place"], plan["share"]).otherwise(0)
    return F.coalesce(size * plan["passes"] + F.when(plan["end_place"].isNull(), 0).otherwise(extra), F.lit(0)).cast("long")


def _planned(texts: DataFrame, plan: list[tuple], number: int) -> DataFrame:
    """One row a group: grp, and a struct of what it takes; number of groups bounded by the caller."""
    made = texts.sparkSession.createDataFrame(plan, PLAN)
    whole = made.join(_ends(texts, made, number), "grp", "left")
    return F.broadcast(whole.select("grp", F.struct("shift", "passes", "end_place", "share").alias("plan")))


def _pattern(sources: Column) -> Column:
    return F.to_json(F.struct(F.array_sort(F.array_distinct(sources)).alias("s")), {"ignoreNullFields": "false"})


def _few(rows: DataFrame, what: str) -> list:
    found = rows.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} {what}")
    return found


def _beside(docs: DataFrame, keys: dict[str, Column], kept: list[str]) -> DataFrame:
    """The kept columns as a struct ``doc``, and the keys: so no names can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), *[k.alias(n) for n, k in keys.items()])


def mix(docs: DataFrame, quotas: dict | None = None, sources_col: str = "sources", id_col: str = "doc_id", size_col: str = "size", repeats: int = 2, seed: int = 17) -> DataFrame:
    """Adds to docs ``taken`` (tokens, repeats counted). ``sources_col``: array of sources that hold the document.

    Without quotas, those of ``targets`` hold, a source's size being that of the
    documents in it.  Documents with one id are told apart by their size; rows
    that agree in both share evenly where a part ends.
    """
    size = F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("long")
    keys = {"grp": _pattern(F.col(f"`{sources_col}`")), "place": _hash(F.lit(seed), F.col(f"`{id_col}`").cast("string"), size), "size": size, "members": F.col(f"`{sources_col}`")}
    kept = [c for c in docs.columns if c != "taken"]
    rows = _beside(docs, keys, kept)
    texts = cut(rows.filter("size > 0").groupBy("grp", "place").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), F.first("members").alias("members")))
    grouped = _few(texts.groupBy("grp").agg(F.first("members").alias("members"), F.sum(F.col("size") * F.col("n")).alias("tokens"), F.count(F.lit(1)).alias("rows")), "membership patterns")
    patterns = [(r["grp"], tuple(dict.fromkeys(r["members"] or ())), int(r["tokens"])) for r in sorted(grouped, key=lambda r: r["grp"])]
    if quotas is None:
        sizes: dict = {}
        for _, members, tokens in patterns:
            for s in members:
                sizes[s] = sizes.get(s, 0) + tokens
        quotas = targets(sizes)
    flows = route([(m, t) for _, m, t in patterns], quotas, repeats)
    plan = [(grp, 0, *_split_plan(sum(flow.values()), tokens)) for (grp, _, tokens), flow in zip(patterns, flows, strict=True)]
    done = rows.join(_planned(texts, plan, sum(r["rows"] for r in grouped)), "grp", "left")
    return done.select(*[F.col(f"doc.`{c}`").alias(c) for c in kept], _taken(F.col("size"), F.col("place"), F.col("plan")).alias("taken"))


MIXED = ["size", "source_size", "target", "taken"]


def source_mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and taken, for documents of one source each that overlap in their texts.

    keep: other columns of the result, without it all.  Rows are read twice, and
    shuffled only if sources overlap.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(text))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in MIXED]
    rows = _beside(docs, {"digest": digest, "source": F.col(f"`{source_col}`").cast("string"), "size": word_count(text)}, kept)
    counted = cut(rows.groupBy("digest", "source").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n")))
    sizes = {r["source"]: int(r["size"]) for r in _few(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")), "sources")}
    quotas = targets(sizes)
    own = _pattern(F.array("source"))
    shared = cut(counted.filter("size > 0").groupBy("digest").agg(F.sum("n").alias("n"), F.collect_set(F.struct("source")).alias("s")).filter(F.size("s") > 1).select("digest", "n", _pattern(F.col("s.source")).alias("pattern")))
    overlaps = shared.limit(1).count() > 0
    known = counted.filter("size > 0")
    known = known.join(shared.select("digest", "pattern"), "digest", "left") if overlaps else known.withColumn("pattern", F.lit(None).cast("string"))
    known = cut(known.withColumn("pattern", F.coalesce("pattern", own)))
    grouped = _few(known.groupBy("pattern", "source").agg(F.sum("size").alias("texts"), F.sum(F.col("size") * F.col("n")).alias("tokens"), F.count(F.lit(1)).alias("rows")), "pairs of a membership pattern and a source")
    plan = _source_plan(grouped, quotas)
    shifts = F.broadcast(spark.createDataFrame([(p, s, f"{p}/{i}", shift) for i, (p, s, shift, *_) in enumerate(plan)], "pattern string, source string, grp string, shift long"))
    place = F.pmod(_hash(F.lit(seed), F.col("digest")) - F.col("shift"), F.lit(1 << BITS))
    same = lambda a, b: (a["pattern"] == b["pattern"]) & a["source"].eqNullSafe(b["source"])
    texts = known.join(shifts, same(known, shifts)).select("grp", place.alias("place"), "size", "n")
    planned = _planned(texts, [(f"{p}/{i}", shift, passes, part) for i, (p, _, shift, passes, part) in enumerate(plan)], sum(r["rows"] for r in grouped))
    told = F.broadcast(spark.createDataFrame([(p, s, f"{p}/{i}") for i, (p, s, *_) in enumerate(plan)], "pattern string, name string, grp string"))
    told = told.join(planned, "grp").select("pattern", "name", "plan")
    if overlaps:
        hot = shared.filter(F.col("n") > max(1, (shared.agg(F.sum("n")).first()[0] or 0) // 1000))  # 1,000 at most
        rest = shared.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select("digest", F.col("pattern").alias("cool"))
        rows = rows.join(F.broadcast(hot.select("digest", F.col("pattern").alias("hot"))), "digest", "left")
        salt = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.monotonically_increasing_id().cast("string"))))  # joins nothing, and spreads
        rows = rows.withColumn("key", salt).join(rest.withColumnRenamed("digest", "key"), "key", "left").withColumn("pattern", F.coalesce("hot", "cool", own))
    else:
        rows = rows.withColumn("pattern", own)
    drop_cut(counted)
    drop_cut(known)
    by_source = F.broadcast(spark.createDataFrame([(k, sizes[k], float(quotas[k])) for k in sizes], "name string, source_size long, target double"))
    done = rows.join(F.broadcast(told.withColumnRenamed("pattern", "at").withColumnRenamed("name", "whose")), (F.col("pattern") == F.col("at")) & F.col("source").eqNullSafe(F.col("whose")), "left")
    done = done.join(by_source, F.col("source").eqNullSafe(F.col("name")))
    at = F.pmod(_hash(F.lit(seed), F.col("digest")) - F.col("plan.shift"), F.lit(1 << BITS))
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": _taken(F.col("size"), at, F.col("plan"))}
    return done.select(*[F.col(f"doc.`{c}`").alias(c) for c in kept], *[v.alias(k) for k, v in added.items()])


def _source_plan(grouped: list, quotas: dict) -> list[tuple]:
    """(pattern, source, shift, passes, part) from rows (pattern, source, texts, tokens): each source may take its documents twice, the uses of a text are counted over all sources."""
    patterns: dict[str, list] = {}
    for r in sorted(grouped, key=lambda r: (r["pattern"], r["source"] is None, r["source"] or "")):
        patterns.setdefault(r["pattern"], []).append(r)
    flows = route([(tuple(r["source"] for r in rs), max(int(r["texts"]) for r in rs)) for rs in patterns.values()], quotas, rooms=[{r["source"]: 2 * int(r["tokens"]) for r in rs} for rs in patterns.values()])
    plan = []
    for (pattern, rs), flow in zip(patterns.items(), flows, strict=True):
        used = 0.0
        for r in rs:
            taken, tokens = flow.get(r["source"], 0), int(r["tokens"])
            plan.append((pattern, r["source"], int(math.modf(used)[0] * (1 << BITS)), *_split_plan(taken, tokens)))
            used += taken / tokens if tokens else 0
    return plan


def op4_mix_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return source_mix(docs.withColumn("doc_id", F.col("doc_id").cast("long")), keep=["doc_id"])
