"""A stored index of vectors: k-means cells as partitions, searched by nearest cells, or exactly by cells' radius bounds.

Cells are fitted on SAMPLE rows at most (those with the smallest hashes of their ids) and every row is indexed. Angles between vectors are a
metric: no row of a cell can be nearer to a query than the angle to the cell's centre less the cell's radius. An exact search reads the
nearest cells until it has k rows, then only cells whose bound is within the k-th distance. Which cells are read is known before rows are: the
scan is pruned to their partitions.

Layout below a folder: `rows/cell=c/` with (id, embedding, angle and any other columns), and `cells` with one row for each cell and insert
(cell, centre, n, radius). Null vectors, and vectors of another length than the first ones, are not indexed. Vectors without a length have a
cell of their own, at distance 1 from everything. A large cell is split over files; its rows never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.operators import vector

#: Rows that the cells are fitted on, cells at most, and rounds of the fit.
SAMPLE, CELLS, ROUNDS = 50_000, 4096, 12
#: Rows and queries of a cell that meet in one task.
ROWS, QUERIES = 20_000, 2_000
#: The cell of vectors without a length.
FLAT = -1
#: Distances are rounded to six digits; bounds allow for that.
SLACK = 2e-6


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows without a length stay zero."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def fitted(sample: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Centres of spherical k-means over unit rows; a centre that loses its rows moves to the row farthest from its own."""
    centres = sample[np.sort(np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False))]
    for _ in range(ROUNDS):
        near = sample @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        bare = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-9)
        if len(bare):
            sums[bare] = sample[np.argsort(near[np.arange(len(own)), own], kind="stable")[: len(bare)]]
        centres = unit(sums)
    return centres


class VectorIndex:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", column: str = "embedding"):
        self.spark, self.path, self.key, self.column = spark, path.rstrip("/"), key, column

    @classmethod
    def build(cls, df: DataFrame, path: str, cells: int | None = None, key: str = "id", column: str = "embedding") -> VectorIndex:
        """Fit cells, about the square root of the rows unless given, and write all rows. An empty table makes an index without cells."""
        self = cls(df.sparkSession, path, key, column)
        with_length = df.where(F.col(column).isNotNull() & (vector.dot(column, column) > 0))
        drawn = with_length.select(F.xxhash64(key).alias("h"), key, column).orderBy("h", key).limit(SAMPLE).toArrow()
        dims = len(drawn.column(column)[0]) if drawn.num_rows else 0
        same = drawn.filter(pa.compute.equal(pa.compute.list_value_length(drawn.column(column)), dims))
        if cells is None:
            cells = int(max(1, min(CELLS, round(with_length.count() ** 0.5)))) if dims else 0
        df.limit(0).write.parquet(f"{self.path}/columns")
        self._write(df, fitted(unit(matrix(same.column(column))), cells) if dims else np.zeros((0, 0)))
        return self

    def insert(self, new: DataFrame) -> None:
        """Append rows to the cells that are there; keys are the caller's to keep apart."""
        self._write(new, self._state()[0])

    def _write(self, df: DataFrame, centres: np.ndarray) -> None:
        key, column, dims = self.key, self.column, centres.shape[1] if centres.size else 0
        told = self.spark.sparkContext.broadcast(centres)  # CELLS rows at most

        def assign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                m = unit(matrix(b.column(column)))
                angle, cell = np.zeros(len(m)), np.full(len(m), FLAT)
                some = np.flatnonzero(m.any(axis=1)) if len(m) else np.zeros(0, np.int64)
                for k in range(0, len(some), 4096):
                    at = some[k : k + 4096]
                    a = angles(m[at], told.value)
                    cell[at] = a.argmin(axis=1)
                    angle[at] = a[np.arange(len(at)), cell[at]]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle), pa.array(cell.astype(np.int32))], [*b.schema.names, "angle", "cell"])

        from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

        kept = df.where(F.size(column) == dims) if dims else df.where("false")
        schema = StructType([*kept.schema.fields, StructField("angle", DoubleType()), StructField("cell", IntegerType())])
        rows = kept.mapInArrow(assign, schema) if dims else kept.select("*", F.lit(0.0).alias("angle"), F.lit(FLAT).alias("cell"))
        rows.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        wrote = self.rows().groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        found = {r.cell: (r.n, r.radius) for r in wrote.collect()}  # CELLS + 1 rows at most
        stats = [(c, centres[c].tolist() if c >= 0 else None, *found.get(c, (0, 0.0))) for c in range(FLAT, len(centres))]
        self.spark.createDataFrame(stats, "cell int, centre array<double>, n long, radius double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")

    def rows(self) -> DataFrame:
        """All indexed rows with their cell; a predicate on `cell` prunes partitions."""
        schema = self.spark.read.parquet(f"{self.path}/columns").schema.add("angle", "double").add("cell", "integer")
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def _state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, and counts and radii with the cell without length last."""
        got = sorted(self.spark.read.parquet(f"{self.path}/cells").collect(), key=lambda r: r.cell)
        flat, cells = got[0], got[1:]
        return np.array([r.centre for r in cells]), np.array([*(r.n for r in cells), flat.n]), np.array([*(r.radius for r in cells), 0.0])

    @staticmethod
    def _bounds(q: np.ndarray, centres: np.ndarray, n: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit queries: each cell's angle, and the least distance that a row of it can have; infinite for empty cells."""
        a = np.full((len(q), len(n)), np.pi / 2)
        if len(centres):
            a[:, :-1] = angles(q, centres)
        low = 1 - np.cos(np.maximum(a - radius, 0))
        low[:, -1] = 1.0
        low[~q.any(axis=1)] = 1.0  # a query without a length is at distance 1 from everything
        return a, np.where(n > 0, low, np.inf)

    def search(self, query: list[float], k: int, probe: int | None = None, where: Column | None = None) -> DataFrame:
        """Nearest k rows with `distance`, ties by key: of the `probe` nearest cells, or of all if not given, reading only cells that can matter."""
        return self._nearest(query, self.cells_for(query, k, probe, where), k, where)

    def cells_for(self, query: list[float], k: int, probe: int | None = None, where: Column | None = None) -> list[int]:
        """The cells that `search` reads."""
        centres, n, radius = self._state()
        q = unit(np.array([query], np.float64))
        angle, low = (x[0] for x in self._bounds(q, centres, n, radius))
        named = lambda cells: [int(c) if c < len(centres) else FLAT for c in cells]
        if probe is not None:
            return named([c for c in np.argsort(angle, kind="stable") if n[c]][:probe])
        order = [c for c in np.lexsort((angle, low)) if n[c]]
        first = order[: int(np.searchsorted(np.cumsum(n[order]), k) + 1)]
        reached = self._nearest(query, named(first), k, where).agg(F.count("*").alias("n"), F.max("distance").alias("d")).first()
        most = reached.d + SLACK if reached.n >= k else np.inf
        return named([c for c in order if low[c] <= most])

    def _nearest(self, query: list[float], cells: list[int], k: int, where: Column | None) -> DataFrame:
        rows = self.rows().where(F.col("cell").isin(cells) if cells else F.lit(False))
        rows = rows if where is None else rows.where(where)
        return vector.top_k(vector.with_distance(rows, query, self.column).drop("angle", "cell"), k, "distance", tie=self.key)

    def search_many(self, queries: DataFrame, k: int, probe: int | None = None) -> DataFrame:
        """(query_id, key, distance, rank) for queries (query_id, embedding), each searched as `search` does.

        First every query meets the rows of its nearest cells, as many as hold k rows or `probe`; the exact way then adds the cells whose
        bound is within the k-th distance found. A cell's rows and queries meet in blocks of ROWS and QUERIES, a matrix product each; a block
        gives k rows for each of its queries.
        """
        state = self._state()
        dims = state[0].shape[1] if state[0].size else 0
        told = self.spark.sparkContext.broadcast(state)
        kind = dict(queries.dtypes)["query_id"]
        asked = queries.where(F.size("embedding") == dims).select("query_id", "embedding")
        bounds = self._bounds

        def visit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The cells of each query: (query_id, embedding, cell); those within `most` without those in the first round, or the first ones."""
            centres, n, radius = told.value
            for b in rows:
                q = unit(matrix(b.column("embedding")))
                angle, low = bounds(q, centres, n, radius)
                most = b.column("most").to_numpy(zero_copy_only=False) if "most" in b.schema.names else None
                own, cells = [], []
                for i in range(len(q)):
                    order = np.lexsort((angle[i], low[i])) if probe is None else np.argsort(angle[i], kind="stable")
                    order = order[n[order] > 0]
                    first = order[:probe] if probe is not None else order[: int(np.searchsorted(np.cumsum(n[order]), k) + 1)]
                    go = first if most is None else np.setdiff1d(order[low[i][order] <= most[i]], first)
                    own += [i] * len(go)
                    cells += [int(c) if c < len(centres) else FLAT for c in go]
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("embedding").take(at), pa.array(cells, pa.int32())], ["query_id", "embedding", "cell"])

        to = f"query_id {kind}, embedding array<double>, cell int"
        asked = asked.withColumn("embedding", F.col("embedding").cast("array<double>"))
        first = self._meet(asked.mapInArrow(visit, to), k, kind)
        if probe is not None:
            return self._best(first, k)
        reached = self._best(first, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance") + SLACK).otherwise(F.lit(float("inf"))).alias("most"))
        more = asked.join(reached, "query_id").mapInArrow(visit, to)
        return self._best(first.unionByName(self._meet(more, k, kind)), k)

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", self.key))  # k rows from each block
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def _meet(self, visits: DataFrame, k: int, kind: str) -> DataFrame:
        key, column = self.key, self.column
        rows = self.rows().select(key, column, "cell")
        own = dict(rows.dtypes)[key]
        sizes = self.spark.read.parquet(f"{self.path}/cells").select("cell", F.ceil(F.col("n") / ROWS).cast("int").alias("blocks"))
        asks = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("asks")).join(F.broadcast(sizes), "cell")  # CELLS + 1 rows
        asks = F.broadcast(asks.where("blocks > 0"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.join(asks, "cell").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).withColumn("ask", upto("asks")).select("cell", "block", "ask", key, column)
        right = visits.join(asks, "cell").withColumn("ask", F.pmod(F.xxhash64("query_id"), F.col("asks")).cast("int")).withColumn("block", upto("blocks")).select("cell", "block", "ask", "query_id", "embedding")

        def nearest(rows: pa.Table, asked: pa.Table) -> pa.Table:
            out = {"query_id": asked.column("query_id").slice(0, 0), key: rows.column(key).slice(0, 0), "distance": pa.array([], pa.float64())}
            if rows.num_rows and asked.num_rows:
                m, q = unit(matrix(rows.column(column))), unit(matrix(asked.column("embedding")))
                order = pa.compute.sort_indices(rows.column(key)).to_numpy()  # ties go by key
                parts = []
                for a in range(0, len(q), 256):
                    d = np.round(1 - q[a : a + 256] @ m[order].T, 6)
                    best = np.argsort(d, axis=1, kind="stable")[:, :k]
                    parts.append((np.repeat(np.arange(a, a + len(d)), best.shape[1]), order[best.ravel()], np.take_along_axis(d, best, 1).ravel()))
                i, j, d = (np.concatenate(x) for x in zip(*parts, strict=True))
                out = {"query_id": asked.column("query_id").take(pa.array(i)), key: rows.column(key).take(pa.array(j)), "distance": pa.array(d)}
            return pa.table(out)

        keys = ("cell", "block", "ask")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, f"query_id {kind}, {key} {own}, distance double")
