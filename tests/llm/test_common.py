import pytest

from vellumspark.llm.common import attach_groups, cut, drop_cut, hot_keys, spread_join, stored
from vellumspark.llm.graph import components


def rows(spark):
    made = [("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(300)] + [(None, -1), ("lone", -2)]
    return spark.createDataFrame(made, "k string, v long")


def groups(spark):
    return spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"g{i}") for i in range(30)], "k string, g string")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("least", [100, 5, 10_000])
def test_spread_join_is_a_join(spark, how, least):
    hot = hot_keys(rows(spark), ["k"], least=least)
    assert (hot is None) == (least == 10_000) and (hot is None or "hot" in [r["k"] for r in hot.collect()])
    want = rows(spark).join(groups(spark), "k", how).collect()
    got = spread_join(rows(spark), groups(spark), ["k"], how, hot).select("k", "v", "g").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_hot_keys_are_bounded(spark):
    assert hot_keys(rows(spark), ["k"], most=3, least=1).count() == 3


def test_attach_groups_is_a_join(spark):
    sizes = rows(spark).filter("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n")
    got = attach_groups(rows(spark), sizes, ["k"], "n", parts=4).collect()
    assert sorted((r["k"], r["v"], r["n"]) for r in got) == sorted((r["k"], r["v"], r["n"]) for r in rows(spark).join(sizes, "k").collect())


def test_cut_and_stored_results_stay_and_go(spark):
    kept, other = cut(rows(spark)), stored(rows(spark))
    assert kept.count() == other.count() == 802 and other.schema == rows(spark).schema
    drop_cut(kept)
    with pytest.raises(Exception):  # noqa: B017
        kept.count()


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(61)}
