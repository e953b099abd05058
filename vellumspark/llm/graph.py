"""Connected components over DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, hot_keys, spread_join


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, root) for every end of an edge (a, b); root is the smallest node of the component.

    Each round hooks parents over edges to the smallest grandparent seen and
    shortens paths, with partial aggregation before every shuffle; the number of
    rounds grows with the logarithm of the longest path.  Nodes with many edges
    and parents of many nodes are joined where their rows are.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    hubs = hot_keys(both, ["b"])
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("parent"), F.lit(True).alias("changed")))
    for _ in range(most_rounds):
        if not state.filter("changed").limit(1).count():
            drop_cut(both)
            return state.select("node", F.col("parent").alias("root"))
        up = state.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        full = cut(spread_join(state.select("node", "parent"), up, ["parent"], "inner", hot_keys(state, ["parent"])).select("node", "parent", "grand"))
        seen = spread_join(both, full.select(F.col("node").alias("b"), F.col("grand").alias("low")), ["b"], "inner", hubs).groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        hooks = full.join(seen, "node")
        moved = (
            hooks.select("node", F.least("low", "grand").alias("parent"))
            .union(hooks.select(F.col("parent").alias("node"), F.col("low").alias("parent")))
            .groupBy("node")
            .agg(F.min("parent").alias("next"))
        )
        before, state = state, cut(state.select("node", "parent").join(moved, "node").select("node", F.least("parent", "next").alias("parent"), (F.col("next") < F.col("parent")).alias("changed")))
        drop_cut(before)
        drop_cut(full)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
