import random
import re

import pytest
from pyspark.sql import functions as F

from vellumspark.llm.quotations import in_reply_order, link_quotations, op3_quotation_linking, passages, quoted_conversations

MESSAGES = "conv_id long, turn long, role string, text string"


def test_passages():
    text = "Hello\nAnn wrote:\n> a\n> b\n>> c\n> > d\n> e\n\nend > not a quote"
    assert passages(text) == [(0, "Hello"), (1, "a\nb"), (2, "c\nd"), (1, "e"), (0, "end > not a quote")]
    assert passages("") == [(0, "")]


def found(df):
    return {(r["conv_id"], r["turn"]): r for r in df.collect()}


def test_links_levels_and_order(spark):
    rows = [
        (1, 0, "u", "First message.\nSecond line here."),
        (1, 1, "a", "> first  MESSAGE.\n> Second line here.\nMy reply"),
        (1, 2, "u", ">> First message.\n> my reply\nThird"),
        (2, 0, "u", "First message.\nSecond line here."),
        (2, 1, "u", "> My reply\nElsewhere"),
        (2, 2, "u", "> never said\n>> my reply\nDeep"),
        (3, 0, "u", "> Third\nbefore all its quotes? no"),
        (0, 0, "u", "> Third\ntoo early to quote"),
        (4, None, "u", "> Third\nno turn"),
        (4, 1, "u", None),
        (4, 2, "u", ""),
        (4, 3, "u", "> \n> \nblank quote"),
    ]
    df = spark.createDataFrame(rows, MESSAGES).withColumns({c: F.lit("x") for c in ("hash", "target", "parent", "root", "own")})
    got = found(link_quotations(df))
    assert len(got) == len(rows)
    parent = {k: (r["parent_conv"], r["parent_turn"]) for k, r in got.items()}
    assert parent[1, 1] == (1, 0) and parent[1, 2] == (1, 1)
    assert parent[2, 1] == (1, 1) and parent[2, 2] == (1, 1) and parent[3, 0] == (1, 2)
    for k in [(1, 0), (2, 0), (0, 0), (4, None), (4, 1), (4, 2), (4, 3)]:
        assert parent[k] == (None, None) and got[k]["depth"] == 0
    assert (got[3, 0]["root_conv"], got[3, 0]["root_turn"], got[3, 0]["depth"]) == (1, 0, 3)
    assert got[1, 2]["text"] == "Third" and got[1, 2]["n_quotes"] == 2 and got[1, 2]["n_linked"] == 2
    rows = [(r["root_conv"], r["conv_id"], r["turn"]) for r in in_reply_order(link_quotations(df)).collect() if r["root_conv"] == 1]
    assert rows == [(1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 2), (1, 3, 0)]


def test_hot_passage_and_long_chain(spark):
    rows = [(i, 0, "u", "Same start") for i in range(200)] + [(i, 1, "u", f"> Same start\nreply {i}") for i in range(200)]
    rows += [(900, i, "u", f"> step {i - 1}\nstep {i}") for i in range(70)]
    got = found(link_quotations(spark.createDataFrame(rows, MESSAGES).repartition(6)))
    assert all((got[i, 1]["parent_conv"], got[i, 1]["parent_turn"]) == (i, 0) for i in range(200))
    assert all(got[900, i]["depth"] == i and got[900, i]["root_turn"] == 0 for i in range(70))


def test_repeated_rows_and_empty(spark):
    rows = [(1, 0, "u", "a b"), (1, 1, "u", "> a b\nc"), (1, 1, "u", "> a b\nc")]
    assert [r["parent_turn"] for r in link_quotations(spark.createDataFrame(rows, MESSAGES)).filter("turn = 1").collect()] == [0, 0]
    assert link_quotations(spark.createDataFrame([], MESSAGES)).count() == 0


def test_query_links_every_quoting_turn(spark, tmp_path):
    rows = [(c, t, "u", f"line {c} {t}\nmore") for c in range(20) for t in range(c % 6 + 1)] + [(50, 0, "u", None), (50, 1, "u", "after nothing")]
    spark.createDataFrame(rows, MESSAGES).write.parquet(f"{tmp_path}/conversations.parquet")
    got = found(op3_quotation_linking(spark, str(tmp_path)))
    assert len(got) == len(rows)
    for c, t, *_ in rows:
        if c < 50:
            assert (got[c, t]["parent_turn"], got[c, t]["root_turn"], got[c, t]["depth"]) == (t - 1 if t else None, 0, t)
    assert got[50, 1]["parent_turn"] is None
    assert quoted_conversations(spark.createDataFrame(rows, MESSAGES)).count() == len(rows)


def brute_links(rows):
    """(conv, turn) -> (parent, root, depth) straight from the rules, by dictionaries; rows: distinct (conv, turn, text)."""
    squeeze = lambda t: " ".join(t.lower().split())
    units = lambda t: [(0, [t]), (1, re.split(r"\n[ \t]*\n", t)), (2, t.split("\n"))]
    own = {(c, t): "\n".join(p for level, p in passages(x or "") if level == 0 and p.strip()) for c, t, x in rows}
    first_here, first_any = {}, {}
    for key in sorted(own):
        for part in {squeeze(p) for _, ps in units(own[key]) for p in ps} - {""}:
            first_here.setdefault((key[0], part), key)
            first_any.setdefault(part, key)
    parent = {}
    for c, t, x in rows:
        found = []
        for place, (level, p) in enumerate(passages(x or "")):
            for unit, parts in units(p) if level else []:
                for part in map(squeeze, parts):
                    here, anywhere = first_here.get((c, part)), first_any.get(part)
                    target = here if here and here < (c, t) else anywhere if anywhere and anywhere < (c, t) else None
                    if part and target:
                        found.append((level, -place, unit, target))
        if found:
            parent[c, t] = min(found)[3]
    out = {}
    for key in own:
        root, depth = key, 0
        while root in parent:
            root, depth = parent[root], depth + 1
        out[key] = parent.get(key), root, depth
    return out, own


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    lines = ["yes", "No thanks.", "what about that one", "Same start", "a longer line of words", ""]
    rows = [(c, t, rng.choice("ua"), "\n".join(rng.choices(lines, k=rng.randint(0, 5)))) for c in range(40) for t in range(rng.randint(1, 7))]
    spark.createDataFrame(rows, MESSAGES).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    mail = quoted_conversations(spark.createDataFrame(rows, MESSAGES)).collect()
    want, own = brute_links([(r["conv_id"], r["turn"], r["text"]) for r in mail])
    got = op3_quotation_linking(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    roles = {(c, t): role for c, t, role, _ in rows}
    for r in got:
        key = (r["conv_id"], r["turn"])
        parent, root, depth = want[key]
        assert (r["parent_conv"], r["parent_turn"]) == (parent or (None, None))
        assert ((r["root_conv"], r["root_turn"]), r["depth"], r["text"], r["role"]) == (root, depth, own[key], roles[key])
    threads = {}
    for key in sorted(want):
        threads.setdefault(want[key][1], []).append(key)
    assert {(r["conv_id"], r["turn"]): r["position"] for r in got} == {key: i for keys in threads.values() for i, key in enumerate(keys)}


def test_quotes_of_every_size(spark):
    rows = [(1, t, "u", f"one {t}\ntwo {t}\n\nthree {t}") for t in range(4)]
    got = {r["turn"]: r["text"] for r in quoted_conversations(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got[0] == rows[0][3]
    assert got[1] == "They wrote:\n> one 0\n> two 0\n> \n> three 0\n" + rows[1][3]
    assert got[2] == "They wrote:\n>> one 0\n>> two 0\n>> \n>> three 0\n> one 1\n> two 1\n" + rows[2][3]
    assert got[3] == "They wrote:\n>> one 1\n>> two 1\n> one 2\n" + rows[3][3]


def test_very_long_texts_and_hot_threads(spark):
    long = "\n".join(f"line {i}" for i in range(30_000))
    rows = [(1, 0, "u", long), (1, 1, "a", "\n".join(f"> {x}" for x in long.split("\n")) + "\nreply"), (2, 0, "u", None)]
    rows += [(10 + i, 0, "u", f"> line 7\nanswer {i}") for i in range(400)] + [(None, None, "u", "lost")] * 3
    got = in_reply_order(link_quotations(spark.createDataFrame(rows, MESSAGES).repartition(4))).collect()
    assert len(got) == len(rows)
    thread = sorted((r["position"], r["conv_id"], r["turn"]) for r in got if r["root_conv"] == 1)
    assert [p for p, *_ in thread] == list(range(402)) and thread[:2] == [(0, 1, 0), (1, 1, 1)]
    assert [r["position"] for r in got if r["conv_id"] is None] == [0, 0, 0]
