import collections
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vellumspark.llm.mixing import min_cost_flow, mix, op4_mix_min_cost_flow, route, source_mix, targets

from . import data


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    fixed = {}
    while True:
        left = 1.5 * sum(sizes.values()) - sum(fixed.values())
        open_ = [k for k in names if k not in fixed]
        share = {k: left * weight[k] / sum(weight[o] for o in open_) for k in open_}
        over = [k for k in open_ if share[k] > 2 * sizes[k]]
        if not over:
            return fixed | share
        fixed |= {k: 2.0 * sizes[k] for k in over}


def test_targets():
    sizes = {"b": 100, "a": 10, None: 40, "Ä": 0, "c": 1000}
    got = targets(sizes)
    assert got == pytest.approx(brute_targets(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * 1150)
    assert targets({}) == {}


def test_min_cost_flow_prefers_cheap_arcs():
    arcs = [(0, 1, 10, 0), (0, 1, 10, 1), (0, 2, 10, 0), (0, 2, 10, 1), (1, 3, 20, 0), (2, 3, 20, 0), (3, 4, 25, 0)]
    flow = min_cost_flow(5, arcs, 0, 4)
    assert sum(flow[:4]) == pytest.approx(25) and flow[0] == flow[2] == pytest.approx(10)


def test_overlapping_sources_use_shared_documents_where_needed():
    # a can only be filled from what it shares with b; b has documents of its own
    flows = route([(("a",), 10), (("a", "b"), 30), (("b",), 60)], {"a": 40, "b": 50})
    assert sum(f.get("a", 0) for f in flows) == pytest.approx(40)
    assert sum(f.get("b", 0) for f in flows) == pytest.approx(50)
    assert flows[2] == {"b": pytest.approx(50)} and flows[1] == {"a": pytest.approx(30)} and flows[0] == {"a": pytest.approx(10)}


def test_small_sources_do_not_depend_on_large_ones():
    small = [((f"s{i}",), i) for i in range(5)]
    flows = route([(("big",), 1_500_000_000), *small], {"big": 2_000_000_000.4, **{f"s{i}": 2.0 * i for i in range(5)}})
    assert flows == [{"big": 2_000_000_000}, {}, *({f"s{i}": 2 * i} for i in range(1, 5))]


def brute_cost(patterns, quotas, repeats):
    """Most tokens that can be sent, and their least cost, by trying all flows of a tiny network."""
    best = (0, 0)
    arcs = [(i, s) for i, (members, _) in enumerate(patterns) for s in members if s in quotas]
    for flow in itertools.product(*[range(min(repeats * patterns[i][1], quotas[s]) + 1) for i, s in arcs]):
        used, sent = collections.Counter(), collections.Counter()
        for (i, s), f in zip(arcs, flow, strict=True):
            used[i] += f
            sent[s] += f
        if all(used[i] <= repeats * t for i, (_, t) in enumerate(patterns)) and all(sent[s] <= q for s, q in quotas.items()):
            cost = sum(r * r * min(t, max(0, used[i] - r * t)) for i, (_, t) in enumerate(patterns) for r in range(repeats))
            best = max(best, (sum(flow), -cost))
    return best


def test_flow_is_least_cost_by_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        patterns = [(tuple(sorted(rng.sample("abc", rng.randint(1, 2)))), rng.randint(0, 3)) for _ in range(rng.randint(1, 3))]
        quotas = {s: rng.randint(0, 5) for s in "abc"}
        flows = route(patterns, quotas, 2)
        used = [sum(f.values()) for f in flows]
        cost = sum(r * r * min(t, max(0, u - r * t)) for u, (_, t) in zip(used, patterns, strict=True) for r in range(2))
        assert (sum(used), -cost) == brute_cost(patterns, quotas, 2)


def test_flow_beats_filling_sources_one_by_one():
    # a alone could take the shared tokens, and b, which has few others, would repeat its own
    flows = route([(("a",), 50), (("a", "b"), 50), (("b",), 10)], {"a": 50, "b": 60})
    assert flows == [{"a": 50}, {"b": 50}, {"b": 10}]


def test_many_patterns_take_seconds():
    rng = random.Random(5)
    names = [f"s{i}" for i in range(40)]
    patterns = [(tuple(rng.sample(names, 3)), rng.randint(1, 1000)) for _ in range(20_000)]
    began = time.perf_counter()
    flows = route(patterns, {s: 600_000 for s in names})
    assert time.perf_counter() - began < 60 and sum(sum(f.values()) for f in flows) > 0


def test_costs_elsewhere_are_refused():
    with pytest.raises(ValueError):
        min_cost_flow(3, [(0, 1, 1, 0), (1, 2, 1, 1)], 0, 2)


def check(rows, got, groups=1):
    sizes, source = {}, {}
    for doc_id, text, _, src, _ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[src] = sizes.get(src, 0) + n
        source[doc_id] = (src, n)
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    copies = collections.Counter((r[3], r[1]) for r in rows)
    assert len(got) == len(rows)
    for r in got:
        src, n = source[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[src] and r["target"] == pytest.approx(want[src])
        assert 0 <= r["taken"] <= 2 * n
        taken[src] += r["taken"]
    for src in sizes:  # the part of a text at which a group ends is shared evenly by its copies
        assert abs(taken[src] - want[src]) <= max(n for (s, _), n in copies.items() if s == src) * groups


@pytest.mark.parametrize("make", [data.odd, data.clashing])
def test_odd_rows(spark, make):
    check(data.ODD, source_mix(make(spark)).collect())


def test_sources_meet_targets_and_reruns_agree(spark, tmp_path):
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 7}", len(t)) for i, t in enumerate(data.prose(600, 4))]
    d = data.write(spark, tmp_path, documents=spark.createDataFrame(rows, data.DOCS).repartition(7))
    first = op4_mix_min_cost_flow(spark, d).collect()
    check(rows, first)
    assert sorted(first) == sorted(op4_mix_min_cost_flow(spark, d).collect())


def test_overlapping_memberships(spark):
    rows = [(i, [["a"], ["a", "b"], ["b", "a"], [], None][i % 5], 10) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    got = mix(docs, {"a": 2500.0, "b": 1500.0}).collect()
    assert abs(sum(r["taken"] for r in got) - 4000) <= 20
    assert all(r["taken"] == 0 for r in got if not r["sources"])


def test_empty(spark):
    assert source_mix(data.empty(spark)).count() == 0


def overlapping():
    texts = data.prose(300, 9)
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i], "en", f"s{(i + 1) % 3}", 0) for i in range(120)]  # in two sources
    return rows + [(2000 + i, texts[0], "en", "s0", 0) for i in range(200)] + [(3000, texts[0], "en", None, 0)]


def test_texts_of_several_sources(spark, tmp_path):
    rows = overlapping()
    d = data.write(spark, tmp_path, documents=spark.createDataFrame(rows, data.DOCS).repartition(5))
    got = op4_mix_min_cost_flow(spark, d).collect()
    check(rows, got, groups=8)
    assert sorted(got) == sorted(op4_mix_min_cost_flow(spark, d).collect())


def test_shared_texts_are_used_once_before_twice(spark):
    # a and b hold the same 200 texts and take half of their words each: no text need be in both halves
    texts = [f"{t} {i}" for i, t in enumerate(data.prose(200, 11))]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(1000 + i, t, "en", "b", 0) for i, t in enumerate(texts)]
    rows += [(5000 + i, f"other {i} " * 20, "en", s, 0) for i, s in enumerate("cdefgh")]
    mixed = {r["doc_id"]: r for r in source_mix(spark.createDataFrame(rows, data.DOCS)).collect()}
    share = mixed[0]["target"] / mixed[0]["source_size"], mixed[1000]["target"] / mixed[1000]["source_size"]
    uses = [(mixed[i]["taken"] + mixed[1000 + i]["taken"]) / mixed[i]["size"] for i in range(200)]
    low = int(sum(share))
    assert sum(not low <= u <= low + 1 for u in uses) <= 3  # but where a part ends


def test_clashing_columns_keep_their_values(spark):
    names = ["part", "before", "passes", "order", "pattern", "bucket", "grp", "place", "doc", "plan", "digest", "key", "hot", "cool", "name", "at", "whose", "shift", "members", "n", "left"]
    docs = spark.createDataFrame(data.ODD, data.DOCS).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    out = source_mix(docs)
    assert set(out.columns) == {*docs.columns, "size", "source_size", "target", "taken"}
    assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in out.collect() for c in names)
    held = docs.withColumns({"sources": F.array("source"), "words": F.lit(3)})
    out = mix(held, {"a": 5.0}, size_col="words")
    assert sorted(out.columns) == sorted([*held.columns, "taken"])
    assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in out.collect() for c in names)


def test_rows_that_agree_share_evenly(spark):
    docs = spark.createDataFrame([(1, ["a"], 7)] * 9 + [(None, ["b"], 5)] * 4, "doc_id long, sources array<string>, size long")
    got = mix(docs, {"a": 40.0, "b": 10.0}).collect()
    assert [r["taken"] for r in got if r["doc_id"] == 1] == [4] * 9 and [r["taken"] for r in got if r["doc_id"] is None] == [2] * 4
