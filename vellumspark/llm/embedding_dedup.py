"""Embedding near-dedup: PCA-ordered tiled comparison.

Equal vectors become one class first, so copies cost nothing further.  The unit
vectors are rotated to the principal axes of all of them (second moments are
summed over every row), strongest axis first.  Tiles are leaves of a k-d tree
over these axes, cut further by hash where a leaf is crowded; two tiles are
compared unless their centres and angular radii rule out the threshold.  Tiles
travel as packed rows, one task compares two groups of tiles, and of a pair of
vectors the product of the leading axes is taken first: with the product of the
two suffix norms added it bounds the cosine, so that most pairs stop there, the
next at half of the axes, and few are summed to the end.  Where a tile is dense
(over ``DENSE`` of its pairs pass) one full matrix product is cheaper than pairs.
A cosine within 1e-9 of the threshold is computed again from the given
components.

A task gives one row per linked vector (how many vectors it links to there, and
the smallest class that it reaches there), never a row per pair.  All pairs that
no bound rules out are compared: for data without structure that grows with the
square of the number of distinct vectors, and each vector is sent to as many
tasks as there are groups that its tile is compared with.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; a shorter vector counts as padded with zeros;
repeated rows are other vectors that link; a null id takes part in counts and
links but never becomes a component id unless the component has no other, and
``kept`` compares null-safely; other columns are not read, so clashing names
are harmless; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_groups, cut, drop_cut, table
from .graph import components

#: Vectors that the k-d tree is cut by (it decides which tiles there are, never what is linked), and tiles at most: larger tables get larger tiles.
SAMPLED, MOST_TILES = 8192, 3000
#: Share of a block's pairs that pass the first bound, above which the block is multiplied in full.
DENSE = 0.02
#: Within this of the threshold a cosine is computed again.
EDGE = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, not empty, all components finite, not all of them zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of doubles, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components would overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Orthonormal columns, by falling second moment over the unit vectors of all rows."""
    upper = np.triu_indices(width)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = unit(rows_of(batch.column(0), width))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])], ["i", "j", "v"])

    found = classes.select("vector").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # width ** 2 / 2 rows
    whole = np.zeros((width, width))
    for r in found:
        whole[r["i"], r["j"]] = whole[r["j"], r["i"]] = r["v"]
    return np.linalg.eigh(whole)[1][:, ::-1].copy()


class Tree:
    """A k-d tree of 2 ** depth leaves over rotated vectors; cut at medians of a sample, along the axis that spreads most."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.axis, self.at = [], []
        leaf = np.zeros(len(sample), np.int64)
        for level in range(depth):
            axis, at = np.zeros(1 << level, np.int64), np.zeros(1 << level)
            for node in range(1 << level):
                held = sample[leaf == node]
                if len(held):
                    axis[node] = np.argmax(held.std(axis=0))
                    at[node] = np.median(held[:, axis[node]])
            self.axis.append(axis)
            self.at.append(at)
            leaf = self._down(sample, leaf, level)

    def _down(self, x: np.ndarray, leaf: np.ndarray, level: int) -> np.ndarray:
        return 2 * leaf + (x[np.arange(len(x)), self.axis[level][leaf]] > self.at[level][leaf])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(x), np.int64)
        for level in range(len(self.axis)):
            leaf = self._down(x, leaf, level)
        return leaf


class Forest:
    """Union of edges between 0 .. n - 1; root[i] is the smallest node that i reaches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            other = x != y
            a, b, x, y = a[other], b[other], x[other], y[other]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


class Tile:
    """Classes of one tile within a task: rotated unit vectors, suffix norms at each stage, and the first bound's factors."""

    def __init__(self, at: int, ids: np.ndarray, copies: np.ndarray, given: np.ndarray, axes: np.ndarray, stages: list[int]):
        self.at, self.ids, self.copies, self.given = at, ids, copies, given
        self.turned = unit(given) @ axes
        self.suffix = [np.sqrt((self.turned[:, s:] ** 2).sum(axis=1)) for s in stages]
        first = stages[0]
        self.bound = np.concatenate((self.turned[:, :first], self.suffix[0][:, None]), axis=1).astype(np.float32)  # one product gives leading part plus suffix bound


def stages_of(width: int) -> list[int]:
    """Axes after which a pair may stop: a quarter, a half."""
    return sorted({max(1, width // 4), max(1, width // 2)})


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision from the given components."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def linked(p: Tile, q: Tile, threshold: float, stages: list[int], rows: int = 1024, columns: int = 4096, pairs: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of p, row of q) of a cosine of at least the threshold; of one tile with itself each pair once."""
    for i in range(0, len(p.ids), rows):
        for j in range(0, len(q.ids), columns):
            may = p.bound[i : i + rows] @ q.bound[j : j + columns].T >= np.float32(threshold - 1e-5)
            if p is q:
                may &= np.arange(i, i + may.shape[0])[:, None] < np.arange(j, j + may.shape[1])
            n = np.count_nonzero(may)
            if not n:
                continue
            if n > DENSE * may.size:
                full = p.turned[i : i + rows] @ q.turned[j : j + columns].T
                a, b = np.nonzero(may & (full >= threshold - EDGE))
                yield from _decided(p, q, a + i, b + j, full[a, b], threshold)
                continue
            every = np.nonzero(may)
            for k in range(0, n, pairs):
                a, b = every[0][k : k + pairs] + i, every[1][k : k + pairs] + j
                done, total = 0, np.zeros(len(a))
                for stage, s in enumerate([*stages, p.turned.shape[1]]):
                    total += np.einsum("ij,ij->i", p.turned[a, done:s], q.turned[b, done:s])
                    rest = p.suffix[stage][a] * q.suffix[stage][b] if stage < len(stages) else 0.0
                    on = total + rest >= threshold - EDGE
                    a, b, total, done = a[on], b[on], total[on], s
                yield from _decided(p, q, a, b, total, threshold)


def _decided(p: Tile, q: Tile, a: np.ndarray, b: np.ndarray, total: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    good = total >= threshold + EDGE
    near = np.flatnonzero(~good)
    if len(near):
        good[near] = cosine(p.given[a[near]], q.given[b[near]]) >= threshold
    if good.any():
        yield a[good], b[good]


def _compare(axes: np.ndarray, group: np.ndarray, kept: np.ndarray, threshold: float):
    width, groups = len(axes), int(group.max()) + 1
    stages = stages_of(width)

    def run(key: tuple, packed: pa.Table) -> pa.Table:
        g, h = divmod(key[0].as_py(), groups)
        tiles = []
        for at, ids, copies, given in zip(*(packed.column(c).to_pylist() for c in ("tile", "ids", "copies", "given")), strict=True):
            tiles.append(Tile(at, np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), np.frombuffer(given, np.float64).reshape(-1, width), axes, stages))
        tiles.sort(key=lambda t: t.at)
        first = dict(zip((t.at for t in tiles), np.cumsum([0, *(len(t.ids) for t in tiles)]).tolist(), strict=False))
        ids, copies = np.concatenate([t.ids for t in tiles]), np.concatenate([t.copies for t in tiles])
        order = np.argsort(ids)  # nodes by class, so that the smallest node is the smallest class
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for p in tiles:
            for q in tiles:
                if q.at < p.at or not kept[p.at, q.at] or (group[p.at], group[q.at]) != (g, h):
                    continue
                for a, b in linked(p, q, threshold, stages):
                    a, b = a + first[p.at], b + first[q.at]
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    forest.add(place[a], place[b])
        some = np.flatnonzero(links)
        return pa.table({"class": ids[some], "links": links[some], "low": ids[order][forest.root[place[some]]]})

    return run


def class_links(classes: DataFrame, threshold: float, tile: int = 2048, group: int = 16_384) -> DataFrame:
    """(class, links, low) of distinct vectors (class, n, vector): rows of other classes that it links to, and a class that it reaches; one row for each task that found a link."""
    spark = classes.sparkSession
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    out = "class long, links long, low long"
    if not n:
        return spark.createDataFrame([], out)
    axes = principal_axes(classes, width)
    tile = max(tile, -(-n // MOST_TILES))
    depth = min(10, max(0, int(np.ceil(np.log2(n / tile)))))
    drawn = classes.orderBy(F.xxhash64("class")).limit(SAMPLED).select("vector").toArrow().column(0).combine_chunks()
    tree = Tree(unit(rows_of(drawn, width)) @ axes, depth)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf(unit(rows_of(batch.column(2), width)) @ axes) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    kind = dict(classes.dtypes)["vector"]
    placed = classes.select("class", "n", "vector").mapInArrow(leaves, f"class long, n long, vector {kind}, leaf long")
    held = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 ** depth leaves
    parts = np.array([-(-held.get(i, 0) // tile) for i in range(1 << depth)])
    base = np.cumsum(parts) - parts
    at = lambda values: F.element_at(F.lit(values.tolist()), (F.col("leaf") + 1).cast("int"))
    tiled = placed.withColumn("tile", at(base) + F.pmod(F.xxhash64("class"), at(parts)))

    def pack(rows: pa.Table) -> pa.Table:
        given = rows_of(rows.column("vector").combine_chunks(), width)
        x = unit(given)
        centre = x.sum(axis=0)
        centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 1e-6 else x[0]
        blob = lambda c: rows.column(c).to_numpy().astype(np.int64).tobytes()
        cells = [rows.column("tile")[0].as_py(), len(x), blob("class"), blob("n"), given.tobytes(), centre.tolist(), float(np.arccos(np.clip((x @ centre).min(), -1, 1)))]
        return pa.table([[c] for c in cells], schema=pa.schema([("tile", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("given", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))

    packed = cut(tiled.groupBy("tile").applyInArrow(pack, "tile long, size long, ids binary, copies binary, given binary, centre array<double>, radius double"))
    tiles = packed.select("tile", "size", "centre", "radius").orderBy("tile").collect()  # MOST_TILES and the tree's leaves at most
    number = {r["tile"]: i for i, r in enumerate(tiles)}  # tiles that hash left empty are no rows
    centre, radius = np.array([r["centre"] for r in tiles]), np.array([r["radius"] for r in tiles])
    apart = np.arccos(np.clip(centre @ centre.T, -1, 1)) - radius[:, None] - radius
    kept = np.cos(np.maximum(apart - 1e-6, 0)) >= threshold
    ends = np.cumsum([r["size"] for r in tiles])
    gathered = (ends - 1) // group
    whose = np.unique(gathered, return_inverse=True)[1]
    groups = int(whose.max()) + 1
    tasks = []
    for i in range(len(tiles)):
        met = np.unique(whose[kept[i]])
        tasks.append((tiles[i]["tile"], i, [int(min(whose[i], m) * groups + max(whose[i], m)) for m in met]))
    dealt = F.broadcast(spark.createDataFrame(tasks, "tile long, place long, tasks array<long>"))
    sent = packed.join(dealt, "tile").select(F.explode("tasks").alias("task"), F.col("place").alias("tile"), "ids", "copies", "given")
    return sent.groupBy("task").applyInArrow(_compare(axes, whose, kept, threshold), out)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tile: int = 2048, group: int = 16_384) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept (id is component_id).

    tile: vectors that are bounded together; group: vectors of each side that a task holds.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine over 0, 1 at most")
    kind = dict(vectors.dtypes)[vector_col]
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    good = rows.filter(usable(F.col("vector")))
    classes = cut(good.groupBy("vector").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).select("vector", "low", "n", F.monotonically_increasing_id().alias("class")))
    found = cut(class_links(classes.select("class", "n", "vector"), threshold, tile, group))
    roots = components(found.filter("class <> low").select(F.col("class").alias("a"), F.col("low").alias("b")).distinct())
    totals = found.groupBy("class").agg(F.sum("links").alias("links"))
    tagged = classes.select("class", "low", "n").join(totals, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    tagged = cut(tagged.select("class", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")))
    ids = tagged.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("many"))
    known = attach_groups(tagged, ids, ["root"], "many").select("class", "n_links", "component_id")
    known = cut(classes.select("class", "vector", "n").join(known, "class").drop("class"))
    drop_cut(found)
    drop_cut(tagged)
    drop_cut(classes)
    linked_rows = attach_groups(good, known, ["vector"], "n").select("id", "n_links", "component_id")
    alone = rows.filter(~usable(F.col("vector"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op12_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
       LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM r GROUP BY a) USING (vec_id)
"""
