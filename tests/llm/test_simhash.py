import random
import re

import numpy as np
import pytest
import xxhash

from vellumspark.llm.graph import components
from vellumspark.llm.simhash import anchors_of, links, near_groups, op9_simhash_anchor, simhash64

from . import data


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    """items: (key, ...); smallest non-null key of each connected group, per item."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (key, *_) in enumerate(items):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return [low.get(find(i)) for i in range(len(items))]


def near_rows():
    rng = random.Random(5)
    texts = []
    for t in data.prose(60, 3, words=200):
        texts.append(t)
        words = t.split()
        for _ in range(3):
            changed = list(words)
            changed[rng.randrange(len(changed))] = "changed"
            texts.append(" ".join(changed))
    return [(i, t, None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("text", [None, "", " \t", "One", "One two", "A b C d e", "é ß " * 50, "w " * 70_000])
def test_fingerprint(text):
    assert simhash64((text or "").encode()) == (brute_print(text) if len(text or "") < 10_000 else brute_print("w w w"))


def test_anchors_cover_every_pair_within_three_bits():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        index, anchor, home = anchors_of(np.array([x, y], np.uint64))
        homes = set(anchor[(index == 0) & home].tolist())
        assert homes & set(anchor[index == 1].tolist())
    assert np.bincount(index).max() <= 34


def test_links_equal_brute_force(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for x in list(prints):
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            prints.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = {tuple(r) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long")).distinct().collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want


@pytest.mark.parametrize("rows", [data.ODD, near_rows()], ids=["odd", "near"])
def test_groups_equal_brute_force(spark, tmp_path, rows):
    d = data.write(spark, tmp_path, documents=spark.createDataFrame(rows, data.DOCS).repartition(5))
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in op9_simhash_anchor(spark, d).collect()), key=str)
    items = [(r[0], brute_print(r[1]) if len(r[1] or "") < 50_000 else simhash64(r[1].encode())) for r in rows]
    low = brute_components(items, lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    assert got == sorted(((k, f"{fp:016x}", c) for (k, fp), c in zip(items, low, strict=True)), key=str)


def test_chain_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001)]
    random.Random(3).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_empty_and_clashing(spark):
    assert near_groups(data.empty(spark)).count() == 0
    assert near_groups(data.clashing(spark)).count() == len(data.ODD)
