import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import embedding_dedup as ed

from . import data

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.9):
    width = max([len(v) for _, v, *_ in rows if v] or [0])
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, *_ in rows]
    x = np.array([[*v, *[0.0] * (width - len(v))] if g else [0.0] * width for (_, v, *_), g in zip(rows, good, strict=True)])
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    norm = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(np.where(norm > 0, norm, 1), np.where(norm > 0, norm, 1)) >= threshold
    near &= np.outer(good, good)
    np.fill_diagonal(near, False)
    out = []
    for i, (vec_id, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((vec_id, int(near[i].sum()), low, vec_id == low))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("id", "n_links", "component_id", "kept").collect()), key=str)


def clusters(n, width, seed, noise=0.2):
    """Chains, clusters, copies, scaled copies and vectors alone, with falling spread by axis."""
    rng = np.random.default_rng(seed)
    spread = 1 / np.arange(1, width + 1) ** 0.5
    centres = rng.normal(size=(n // 10, width)) * spread
    x = centres[rng.integers(0, len(centres), n)] + noise * rng.normal(size=(n, width)) * spread
    x[: n // 10] = x[n // 2 : n // 2 + n // 10]
    x[n // 10 : n // 5] = 3 * x[n // 2 : n // 2 + n // 5 - n // 10]
    return [(i, v.tolist(), 0) for i, v in enumerate(x)]


@pytest.mark.parametrize("width,noise,tile,group", [(16, 0.2, 32, 64), (64, 0.3, 2048, 16384), (5, 0.4, 16, 16), (1, 0.2, 8, 16)])
def test_equals_brute_force(spark, width, noise, tile, group):
    rows = clusters(300, width, 3, noise)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(ed.near_vectors(df, tile=tile, group=group)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0], 1), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 0.0], 0), (7, [nan, 1.0, 0.0], 0)]
    rows += [(8, [inf, 1.0, 0.0], 0), (None, [1.0, 0.1, 0.0], 0), (9, [1.0, 0.1], 0), (10, [1e300, 0.0, 0.0], 0), (11, [1e-300, 0.0, 0.0], 0), (12, [-1.0, 0.0, 0.0], 0), (None, None, 0), (None, [0.0, 0.0, 1.0], 0), (13, [-0.0, 1.0, 0.0], 0), (14, [0.0, 1.0, -0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted([(v, n, low, v == low) for v, n, low, _ in brute(rows)], key=str)
    assert found(ed.near_vectors(df)) == want
    clash = df.withColumns({c: F.lit("clash") for c in [*data.CLASH, "vector", "class", "n_links", "low", "tile", "leaf", "root"] if c != "label"})
    assert found(ed.near_vectors(clash)) == want
    assert ed.near_vectors(df.limit(0)).count() == 0 and ed.near_vectors(df.filter("vec_id = 3")).count() == 1


def test_pairs_at_the_threshold(spark):
    """Cosines of exactly 0.9 and the doubles next to it are told apart."""
    rows = []
    for i, c in enumerate([0.9, float(np.nextafter(0.9, 1)), 0.9 - 1e-12, 0.9 + 1e-12, 0.8999, 0.9001]):
        at = [0.0] * 12
        at[2 * i] = 1.0
        to = list(at)
        to[2 * i], to[2 * i + 1] = c, float(np.sqrt(1 - c * c))
        rows += [(2 * i, at, 0), (2 * i + 1, to, 0)]
    x = np.array([r[1] for r in rows])
    near = [bool(ed.cosine(x[i : i + 1], x[i + 1 : i + 2])[0] >= 0.9) for i in range(0, 12, 2)]
    got = {r["id"]: r["n_links"] for r in ed.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] == 1 for i in range(0, 12, 2)] == near and near[2:] == [False, True, False, True]


def test_copies_and_a_dense_cluster_make_few_rows(spark):
    """A third of all rows is one vector, another third one cluster: rows of the tasks stay below one a class and task."""
    rng = np.random.default_rng(1)
    one = rng.normal(size=8)
    rows = [(i, one.tolist(), 0) for i in range(400)]
    rows += [(400 + i, (np.eye(8)[0] + 0.01 * rng.normal(size=8)).tolist(), 0) for i in range(400)] + [(800 + i, rng.normal(size=8).tolist(), 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(ed.near_vectors(df, tile=64, group=128)) == brute(rows)
    distinct = df.groupBy(F.col("embedding").alias("vector")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("class")).select("class", "n", "vector")
    assert ed.class_links(distinct, 0.9, 64, 128).count() <= 801 * (801 // 128 + 1)


def test_stages_stop_pairs_and_bounds_skip_tiles():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 16)) / np.arange(1, 17)
    axes = np.linalg.eigh(ed.unit(x).T @ ed.unit(x))[1][:, ::-1]
    make = lambda v: ed.Tile(0, np.arange(len(v)), np.ones(len(v), np.int64), v, axes, ed.stages_of(16))
    p, q = make(x[:120]), make(x[80:])
    got = {(int(i), int(j)) for a, b in ed.linked(p, q, 0.9, ed.stages_of(16), rows=50, columns=33, pairs=17) for i, j in zip(a, b, strict=True)}
    full = ed.unit(x[:120]) @ ed.unit(x[80:]).T
    assert got == set(zip(*(v.tolist() for v in np.nonzero(full >= 0.9)), strict=True)) and len(got) > 40
    first = (p.bound @ q.bound.T >= 0.9).sum()
    assert len(got) <= first < 0.9 * full.size


def test_query(spark, tmp_path):
    rows = clusters(120, 8, 5)
    d = data.write(spark, tmp_path, embeddings=spark.createDataFrame(rows, SCHEMA))
    got = ed.op12_embedding_tiles(spark, d)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
