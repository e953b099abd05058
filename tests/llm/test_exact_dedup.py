import hashlib
import re

import pytest

from vellumspark.llm.exact_dedup import exact_dedup, merge_runs, digest_rows, op8_exact_dedup

from . import data


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for norm, members in groups.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        for i, (_, none, doc_id) in enumerate(members):
            out.append((None if none else doc_id, keep, len(members), i == 0, sha))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("make", [data.odd, data.clashing])
def test_odd_rows(spark, make):
    assert found(exact_dedup(make(spark))) == brute(data.ODD)


@pytest.mark.parametrize("fan_in", [2, 4, 7])
def test_fan_in_and_hot_group(spark, fan_in):
    texts = data.prose(300, 1) + ["hot copy"] * 400 + ["hot  copy"] * 50
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, data.DOCS).repartition(11)
    assert found(exact_dedup(df, fan_in=fan_in)) == brute(rows)


def test_every_slot_holds_its_own_range(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(data.prose(200, 2))]
    merged = merge_runs(digest_rows(spark.createDataFrame(rows, data.DOCS)), fan_in=2, slots=16).collect()
    assert sum(r["group_size"] for r in merged) == 200
    assert len({bytes(r["digest"]) for r in merged}) == len(merged)


def test_empty_and_query(spark, tmp_path):
    assert exact_dedup(data.empty(spark)).count() == 0
    d = data.write(spark, tmp_path, documents=data.odd(spark))
    got = op8_exact_dedup(spark, d)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found(got) == brute(data.ODD)
