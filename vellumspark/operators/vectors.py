"""Vector collections: keyed points in buckets, a log of changes, and an approximate index that searches see at once.

``points`` holds the points in buckets by id; ``changes`` the upserts and
deletions since, numbered folders of which the highest wins.  Every read puts
both together; ``compact`` merges the changes into the points and the index.  What
is replaced in place is written aside first, and the next call finishes what a
failure cut off.

The index has two levels of cells (centres by spherical k-means on a bounded
sample; every point is in the index) in folders that a scan prunes, and each
point's product-quantised code.  A search reads the codes of the cells nearest
to each query, and scores the best of them again by their vectors; where these
would be as many as the points, it reads the vectors at once.  The number of
cells grows with the points, so that a query reads about as many points in a
larger collection; how many cells and candidates reach the wanted recall is
measured on all points when the index is built.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, StructType

from ..storage import drop_folder, exists
from .retrieval import MOST_SENT, _unit, dense_search, matrix, small, top_k

#: Points that centres and codes are fitted on, and queries that recall is measured with: bounds, whatever the collection's size.
MOST_SAMPLED, MOST_TRIED = 20_000, 200
#: Points of a cell that are aimed at, and cells at most (the sample gives each some ten points).
CELL_POINTS, MOST_CELLS = 1000, 2048
#: Candidates that a task holds before it hands them on, and queries that are scored at once.
MOST_HELD, AT_ONCE = 500_000, 256


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centres of unit vectors."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        empty = np.bincount(nearest, minlength=cells) == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centres = _unit(sums)
    return centres


class Cells:
    """Two levels: coarse centres, and the fine centres of each; cell = coarse number * width + fine number."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.coarse = fit_cells(sample, max(1, round(np.sqrt(cells))))
        nearest = np.argmax(sample @ self.coarse.T, axis=1)
        per = max(1, -(-cells // len(self.coarse)))
        self.fine = [fit_cells(sample[nearest == c] if (nearest == c).any() else self.coarse[c : c + 1], per) for c in range(len(self.coarse))]
        self.width = max(map(len, self.fine))
        self.numbers = np.concatenate([c * self.width + np.arange(len(f)) for c, f in enumerate(self.fine)])
        self.centres = np.concatenate(self.fine)

    def assign(self, x: np.ndarray) -> np.ndarray:
        coarse = np.argmax(x @ self.coarse.T, axis=1)
        out = np.zeros(len(x), np.int32)
        for c in np.unique(coarse):
            mine = coarse == c
            out[mine] = c * self.width + np.argmax(x[mine] @ self.fine[c].T, axis=1)
        return out

    def nearest(self, q: np.ndarray, probes: int) -> np.ndarray:
        """Of each query the numbers of its nearest cells, best first."""
        return self.numbers[np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]]


class Codes:
    """Product quantisation: each slice of a unit vector as the number of its nearest of at most 256 centres."""

    def __init__(self, sample: np.ndarray, slices: int, rounds: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.cuts = np.linspace(0, sample.shape[1], min(slices, sample.shape[1]) + 1).astype(int)
        self.books = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            x = sample[:, a:b]
            book = x[rng.choice(len(x), min(256, len(x)), replace=False)]
            for _ in range(rounds):
                near = self._near(x, book)
                n = np.bincount(near, minlength=len(book))
                sums = np.zeros_like(book)
                np.add.at(sums, near, x)
                book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
            self.books.append(book)

    @staticmethod
    def _near(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.argmin((book**2).sum(axis=1) - 2 * (x @ book.T), axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self._near(x[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, code: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for: of each slice its centre."""
        return np.concatenate([book[code[:, j]] for j, book in enumerate(self.books)], axis=1)


class Nearest:
    """The k best points (rounded cosine, then smallest id) of each of many queries.

    A block of queries and points is multiplied in single precision, which with its
    largest error decides what can be among the best; only that is scored in doubles.
    It is held as rows (query, score, point), which are cut to k a query together.
    """

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.single, self.k = q, q.astype(np.float32), k
        #: What a product of unit vectors in single precision and the rounding may be off.
        self.error = 1e-6 + (q.shape[1] + 8) * 2.0**-24
        self.clear()

    def clear(self) -> None:
        #: What a product has to reach.
        self.bound = np.full(len(self.q), -np.inf, np.float32)
        self.held = np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.names: list[pa.Array] = []
        self.named = self.waiting = 0

    def open(self, names: pa.Array) -> int:
        """Takes the ids of a batch; the number of its first point. Of earlier ones only the ids that are held stay."""
        if self.named > max(MOST_HELD, 2 * len(self.held[0])):
            self.cut()
            query, score, point = self.held
            some, point = np.unique(point, return_inverse=True)
            self.held, self.names, self.named = (query, score, point), [self._names(some)], len(some)
        self.names.append(names)
        self.named += len(names)
        return self.named - len(names)

    def _names(self, points: np.ndarray) -> pa.Array:
        return pa.concat_arrays(self.names).take(pa.array(points))

    def add(self, rows: np.ndarray, x: np.ndarray, point: np.ndarray) -> None:
        """The queries of these numbers by points: finite vectors of length 1 at most, and their numbers."""
        if len(point) > self.k:
            mine = self._few_of_equal(x, point)
            x, point = x[mine], point[mine]
        single, most = x.astype(np.float32).T, max(1, 4_000_000 // x.shape[1])
        for a in range(0, len(rows) if len(point) else 0, AT_ONCE):
            some = rows[a : a + AT_ONCE]
            scores, bound = self.single[some] @ single, self.bound[some]
            first = np.flatnonzero(np.isneginf(bound))
            if len(first) and len(point) > self.k:
                bound[first] = np.partition(scores[first], -self.k, axis=1)[:, -self.k] - np.float32(2 * self.error)
                self.bound[some] = bound
            pairs = np.flatnonzero(scores >= bound[:, None])
            for b in range(0, len(pairs), most):
                at, found = np.divmod(pairs[b : b + most], len(point))
                self.fresh.append((some[at].astype(np.int32), np.round(np.einsum("ij,ij->i", self.q[some[at]], x[found]), 6), point[found]))
                self.waiting += len(at)
                if self.waiting > max(50_000, 2 * len(self.held[0])):
                    self.cut()

    def _few_of_equal(self, x: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Places of the points without those that k equal ones of smaller id come before, for any query."""
        kind, n = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_inverse=True, return_counts=True)[1:]
        if n.max() <= self.k:
            return np.arange(len(point))
        order = np.lexsort((pc.rank(self._names(point), tiebreaker="dense").to_numpy(), kind))
        return np.sort(order[_nth(kind[order]) < self.k])

    def cut(self) -> None:
        """Only the k best of each query stay."""
        query, score, point = (np.concatenate(c) for c in zip(self.held, *self.fresh, strict=True))
        if len(query):
            some, place = np.unique(point, return_inverse=True)
            rank = pc.rank(self._names(some), tiebreaker="dense").to_numpy().astype(np.int64)[place]
            order = np.lexsort((rank, -score, query))
            query, score, point = query[order], score[order], point[order]
            nth = _nth(query)
            last, keep = nth == self.k - 1, nth < self.k
            self.bound[query[last]] = np.maximum(self.bound[query[last]], (score[last] - self.error).astype(np.float32))
            query, score, point = query[keep], score[keep], point[keep]
        self.held, self.fresh, self.waiting = (query, score, point), [], 0

    def batches(self, qids: pa.Array, kind: pa.DataType, at_once: int = 10_000) -> Iterator[pa.RecordBatch]:
        """Rows of (qid, chunk_id, score), the ids in the types of their columns."""
        self.cut()
        query, score, point = self.held
        for a in range(0, len(query), at_once):
            some = slice(a, a + at_once)
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(query[some])), self._names(point[some]).cast(kind), pa.array(score[some])], ["qid", "chunk_id", "score"])


def _nth(sorted_: np.ndarray) -> np.ndarray:
    """Of each of the values, which lie in order, how many equal ones come before it."""
    begin = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    return np.arange(len(sorted_)) - np.repeat(begin, np.diff(np.r_[begin, len(sorted_)]))


class Collection:
    """points(id, vector, payload) under a folder. One writer at a time; points without id or vector can't be stored; ids are unique, the last version wins."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, most_changes: int = 1_000_000):
        self.spark, self.path, self.buckets, self.most_changes = spark, path.rstrip("/"), buckets, most_changes

    # --- points

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/points") or exists(self.spark, f"{self.path}/replacing/_SUCCESS")

    def drop(self) -> None:
        drop_folder(self.spark, self.path)

    def create(self, points: DataFrame) -> None:
        """A new collection with the columns of these points; one of that name is replaced once they are written."""
        self._bucketed(points).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/replacing")
        self._finish()

    def _bucketed(self, points: DataFrame) -> DataFrame:
        return points.filter("vector IS NOT NULL AND id IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))

    def _finish(self) -> None:
        """Puts in place what stands whole beside it: a new collection, or merged buckets and cells."""
        if exists(self.spark, f"{self.path}/replacing/_SUCCESS"):
            for name in ("points", "cells", "index", "changes", "merged", "merged_cells"):
                drop_folder(self.spark, f"{self.path}/{name}")
            self.spark.read.parquet(f"{self.path}/replacing").write.partitionBy("bucket").parquet(f"{self.path}/points")
            drop_folder(self.spark, f"{self.path}/replacing")
        if exists(self.spark, f"{self.path}/merged/_SUCCESS"):
            for aside, table, key in (("merged", "points", "bucket"), ("merged_cells", "cells", "cell")):
                if exists(self.spark, f"{self.path}/{aside}/_SUCCESS"):
                    kind = self.spark.read.parquet(f"{self.path}/{table}").schema
                    new = self.spark.read.schema(kind).parquet(f"{self.path}/{aside}")
                    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{self.path}/{table}")
            drop_folder(self.spark, f"{self.path}/changes")
            drop_folder(self.spark, f"{self.path}/merged")  # first of the two: without it the other is not looked at
            drop_folder(self.spark, f"{self.path}/merged_cells")

    def _base(self) -> DataFrame:
        self._finish()
        return self.spark.read.parquet(f"{self.path}/points").filter("id IS NOT NULL")

    def _changes(self) -> DataFrame | None:
        """The newest change of each id; ``gone`` marks a deletion."""
        if not exists(self.spark, f"{self.path}/changes"):
            return None
        all_ = self.spark.read.parquet(f"{self.path}/changes")
        rest = F.struct(*[c for c in all_.columns if c != "id"])
        return all_.groupBy("id").agg(F.max_by(rest, F.col("n")).alias("row")).select("id", "row.*").drop("n")

    def points(self) -> DataFrame:
        """All valid points."""
        held, changes = self._base().drop("bucket"), self._changes()
        if changes is None:
            return held
        return held.join(changes.select("id"), "id", "left_anti").unionByName(changes.filter("NOT gone").drop("gone"))

    def lookup(self, ids: DataFrame) -> DataFrame:
        return self.points().join(ids.select("id").distinct(), "id", "left_semi")

    def scroll(self, after: str | None, most: int) -> DataFrame:
        """The next points in the order of their ids."""
        points = self.points()
        return (points.filter(F.col("id") > after) if after is not None else points).orderBy("id").limit(most)

    def _log(self, rows: DataFrame) -> None:
        held = self._base().drop("bucket")
        shaped = rows.select(*[F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in held.dtypes], "gone")
        changes, n = f"{self.path}/changes", 0
        if exists(self.spark, changes):
            n = (self.spark.read.parquet(changes).agg(F.max("n")).first()[0] or 0) + 1
        shaped.write.mode("overwrite").parquet(f"{changes}/n={n}")
        if self.spark.read.parquet(changes).count() > self.most_changes:
            self.compact()

    def upsert(self, points: DataFrame) -> None:
        """Points by id, the incoming ones win; doing it again changes nothing. Of repeated ids in one call any one counts."""
        fresh = points.filter("vector IS NOT NULL AND id IS NOT NULL")
        if not fresh.isEmpty():
            self._log(fresh.withColumn("gone", F.lit(False)))

    def delete(self, ids: DataFrame) -> None:
        """Removes the points of these ids; ids that are not there change nothing."""
        known = ids.select("id").filter("id IS NOT NULL").distinct()
        if not known.isEmpty():
            self._log(known.withColumn("gone", F.lit(True)))

    def compact(self) -> None:
        """Merges the changes into the points, and into the index if there is one; only buckets and cells that are met are written."""
        held, changes = self._base(), self._changes()
        if changes is None:
            return
        live = self._bucketed(changes.filter("NOT gone").drop("gone"))
        met = [r["bucket"] for r in changes.select(F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("bucket")).distinct().collect()]
        if exists(self.spark, f"{self.path}/index"):
            cells, kept = self.spark.read.parquet(f"{self.path}/cells").filter("id IS NOT NULL"), changes.select("id")
            placed = self._placed(live.drop("bucket"), *self._model()[:2])
            touched = [r["cell"] for r in cells.join(kept, "id", "left_semi").select("cell").union(placed.select("cell")).distinct().collect()]  # MOST_CELLS at most
            new = cells.filter(F.col("cell").isin(touched)).join(kept, "id", "left_anti").unionByName(placed)
            self._with_empty(new, "cell", touched).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/merged_cells")
        new = held.filter(F.col("bucket").isin(met)).join(changes.select("id"), "id", "left_anti").unionByName(live)
        self._with_empty(new, "bucket", met).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/merged")
        self._finish()

    def _with_empty(self, rows: DataFrame, key: str, met: list[int]) -> DataFrame:
        """The rows, and for each folder that is met one row without id, so that a folder that loses all its points is replaced as well."""
        blanks = self.spark.createDataFrame([(m,) for m in met], f"{key} int")
        return rows.unionByName(blanks.select(*[F.col(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]))

    # --- index

    def _placed(self, points: DataFrame, cells: Cells, codes: Codes) -> DataFrame:
        """Points with code and cell."""
        at = points.columns.index("vector")
        schema = StructType(list(points.schema.fields)).add("code", BinaryType()).add("cell", IntegerType())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _unit(matrix(batch.column(at)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes.encode(x)], pa.binary()), pa.array(cells.assign(x))], [*batch.schema.names, "code", "cell"])

        return points.mapInArrow(run, schema)

    def _model(self) -> tuple[Cells, Codes, dict]:
        row = self.spark.read.parquet(f"{self.path}/index").first()
        cells, codes = object.__new__(Cells), object.__new__(Codes)
        array = lambda x: np.array(x, np.float64)
        cells.coarse, cells.fine, cells.width = array(row["coarse"]), [array(f) for f in row["fine"]], row["width"]
        cells.numbers = np.concatenate([c * cells.width + np.arange(len(f)) for c, f in enumerate(cells.fine)])
        cells.centres = np.concatenate(cells.fine)
        codes.cuts, codes.books = np.array(row["cuts"]), [array(b) for b in row["books"]]
        return cells, codes, {"probes": row["probes"], "refine": row["refine"], "recall": row["recall"], "points": row["points"]}

    def _save(self, cells: Cells, codes: Codes, told: dict) -> None:
        lists = lambda xs: [x.tolist() for x in xs]
        row = (cells.coarse.tolist(), [f.tolist() for f in cells.fine], int(cells.width), codes.cuts.tolist(), lists(codes.books), told["probes"], told["refine"], told["recall"], told["points"])
        schema = "coarse array<array<double>>, fine array<array<array<double>>>, width int, cuts array<int>, books array<array<array<double>>>, probes int, refine int, recall double, points long"
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index")

    def build_index(self, cells: int | None = None, k: int = 10, recall: float = 0.95, slices: int = 16) -> dict:
        """Writes the index of all points; the cells to look into, the candidates to score again, and the recall measured with them."""
        self.compact()
        points = self.points()
        n = points.count()
        share = 1.2 * MOST_SAMPLED / max(n, 1)  # hashes lie evenly: some more than are taken lie below, and few go to the driver
        least = (1 << 63) - 1 if share >= 1 else int((2 * share - 1) * (1 << 63))
        sampled = points.filter(F.xxhash64("id") <= least).select("id", "vector").orderBy(F.xxhash64("id")).limit(MOST_SAMPLED).collect()
        if not sampled:
            raise ValueError("no points to index")
        sample = _unit(np.array([r["vector"] for r in sampled], np.float64))
        asked, fitted = sample[:MOST_TRIED], sample[MOST_TRIED:] if len(sample) > 10 * MOST_TRIED else sample  # most queries are not fitted on
        wanted = cells or min(MOST_CELLS, max(16, n // CELL_POINTS))
        made, codes = Cells(fitted, wanted), Codes(fitted, slices)
        placed = self._placed(points, made, codes)
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/cells")
        tried = self.spark.createDataFrame([(i, r["vector"]) for i, r in enumerate(sampled[:MOST_TRIED])], "qid int, vector array<double>")
        exact = dense_search(points, tried, k, "id", "vector").select("qid", F.col("chunk_id").alias("id")).collect()
        place = {r["id"]: r["cell"] for r in self.spark.read.parquet(f"{self.path}/cells").join(small(self.spark.createDataFrame([(r["id"],) for r in exact], points.select("id").schema).distinct()), "id", "left_semi").select("id", "cell").collect()}
        near = made.nearest(asked, len(made.numbers))
        rank = np.array([np.flatnonzero(near[r["qid"]] == place[r["id"]])[0] for r in exact])
        aim = recall + (1 - recall) / 2  # what the cells may lose; the codes may lose as much
        probes = next(p for p in range(1, len(made.numbers) + 1) if (rank < p).mean() >= aim)
        told = {"probes": probes, "refine": 0, "recall": 0.0, "points": n}
        self._save(made, codes, told)
        truth, refine = {(r["qid"], r["id"]) for r in exact}, 4 * k
        while True:
            got = {(r["qid"], r["chunk_id"]) for r in self.search(tried, k, probes, refine).collect()}
            told |= {"refine": refine, "recall": len(got & truth) / len(truth)}
            if told["recall"] >= recall or refine >= n:
                break
            refine *= 2
        self._save(made, codes, told)
        return told

    def search(self, queries: DataFrame, k: int, probes: int | None = None, refine: int | None = None, block: int = 10_000) -> DataFrame:
        """(qid, chunk_id, score, rank) of queries (qid, vector): cosine top k of the valid points, changes included.

        Indexed points are found in each query's ``probes`` nearest cells: the
        ``refine`` best by code are scored by their vectors (0: all are).  Of a block
        whose best by code would be as many as the points, all are scored by their
        vectors unless ``refine`` is given: that finds what the codes find, and more.
        Changed and new points are all compared.  Any number of queries: blocks of
        about ``block`` by a hash of the id are searched by themselves.
        """
        self._finish()
        blocks = max(1, -(-queries.count() // block))
        parts = [queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [queries]
        model, changes = self._model(), self._changes()
        held = self.spark.read.parquet(f"{self.path}/cells").filter("id IS NOT NULL")  # its many folders are listed once
        return functools.reduce(DataFrame.unionByName, [self._search_block(part, model, held, changes, k, probes, refine) for part in parts])

    def _search_block(self, queries: DataFrame, model: tuple[Cells, Codes, dict], held: DataFrame, changes: DataFrame | None, k: int, probes: int | None, refine: int | None) -> DataFrame:
        cells, codes, told = model
        probes = told["probes"] if probes is None else probes
        rows = [r for r in queries.select("qid", "vector").collect() if r["vector"] is not None]
        if refine is None:
            refine = told["refine"] if len(rows) * told["refine"] < told["points"] else 0
        key, name = queries.schema["qid"].dataType, held.schema["id"].dataType
        schema = f"qid {key.simpleString()}, chunk_id {name.simpleString()}, score double"
        if not rows:
            return self.spark.createDataFrame([], f"{schema}, rank int")
        kinds = to_arrow_type(key), to_arrow_type(name)
        ids, q = [r["qid"] for r in rows], _unit(np.array([r["vector"] for r in rows], np.float64))
        every = np.arange(len(ids))
        if probes >= len(cells.numbers):
            wanted = None  # each cell by each query
        else:
            near = cells.nearest(q, probes)
            order = np.argsort(near, axis=None, kind="stable")
            cell, begin = np.unique(near.ravel()[order], return_index=True)
            wanted = dict(zip(cell.tolist(), np.split((order // near.shape[1]).astype(np.int32), begin[1:]), strict=True))
            held = held.filter(F.col("cell").isin(list(wanted)))
        valid = held if changes is None else held.join(small(changes.select("id")), "id", "left_anti")

        def by_cell(vectors, most: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best, seen, qids = Nearest(q, most), np.zeros(len(ids), bool), pa.array(ids, kinds[0])
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x, cell = vectors(batch), batch.column("cell").to_numpy()
                    first, whole = best.open(batch.column("id")), np.isfinite(x).all(axis=1)
                    for c in np.unique(cell).tolist():
                        mine = np.flatnonzero((cell == c) & whole)
                        asked = every if wanted is None else wanted[c]
                        best.add(asked, x[mine], first + mine)
                        seen[asked] = True
                        if seen.sum() * most > MOST_HELD:
                            yield from best.batches(qids, kinds[1])
                            best.clear()
                            seen[:], first = False, best.open(batch.column("id"))
                yield from best.batches(qids, kinds[1])

            return run

        def exact(points: pa.RecordBatch) -> np.ndarray:
            return _unit(matrix(points.column("vector")))

        def coded(points: pa.RecordBatch) -> np.ndarray:
            return codes.decode(np.frombuffer(b"".join(points.column("code").to_pylist()), np.uint8).reshape(points.num_rows, -1))

        if refine:
            likely = top_k(valid.select("id", "code", "cell").mapInArrow(by_cell(coded, refine), schema), refine).select("qid", F.col("chunk_id").alias("id"))
            found = self._rescored(held, likely, refine, ids, q, schema, kinds)
        else:
            found = valid.select("id", "vector", "cell").mapInArrow(by_cell(exact, k), schema)
        if changes is not None:
            fresh = dense_search(changes.filter("NOT gone"), queries, k, "id", "vector", most_queries=len(ids) + 1)
            found = found.unionByName(fresh.drop("rank"))
        return top_k(found, k)

    def _rescored(self, held: DataFrame, likely: DataFrame, refine: int, ids: list, q: np.ndarray, schema: str, kinds: tuple) -> DataFrame:
        """Exact scores of candidates (qid, id)."""
        number = self.spark.createDataFrame([(x, i) for i, x in enumerate(ids)], f"{schema.split(',')[0]}, at int")
        asked = likely.join(F.broadcast(number), "qid").select("id", "at")
        pairs = held.select("id", "vector").join(F.broadcast(asked) if len(ids) * refine <= MOST_SENT else asked.hint("merge"), "id")  # vectors never go through the driver

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at = batch.column("at").to_numpy()
                    score = np.round(np.einsum("ij,ij->i", q[at], _unit(matrix(batch.column("vector")))), 6)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at.tolist()], kinds[0]), batch.column("id").cast(kinds[1]), pa.array(score)], ["qid", "chunk_id", "score"])

        return pairs.mapInArrow(run, schema)
