"""Pairs of vectors within an angle, exactly: cells around pivots, and the triangle inequality over angles.

Rows are written once, as tiles: a cell's rows in order of their angle to its pivot, cut to TILE rows. What is known of a tile is its pivot and
its least and largest angle. Two tiles meet only if these allow a pair within the angle asked for, and of tiles that meet only those rows
whose angle to the other's pivot allows it are multiplied. A pair of tiles is a row that names two files: tasks read what they need, and
no vector is shuffled a second time, however many pairs there are.

Pivots are centres of a bounded sample (see vector_index.fitted), CELLS at most. Null vectors, vectors without a length, and vectors of
another length than the sample's first take no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import vector
from memloom.operators.shared import make_dir, scratch, store_of, stored
from memloom.operators.vector_index import angles, fitted, matrix, unit

TILE, CELLS, SAMPLE = 2000, 1024, 50_000
#: What rounding may add to an angle.
SLACK = 1e-6


class Pivots:
    """Centres that a table's rows are told apart by."""

    def __init__(self, df: DataFrame, key: str, column: str, cells: int | None = None):
        has = df.where(F.col(column).isNotNull() & (vector.dot(column, column) > 0))
        drawn = has.select(F.xxhash64(key).alias("h"), key, column).orderBy("h", key).limit(SAMPLE).toArrow().column(column)
        self.dims = len(drawn[0]) if len(drawn) else 0
        m = unit(matrix(drawn.filter(pa.compute.equal(pa.compute.list_value_length(drawn), self.dims)))) if self.dims else np.zeros((0, 0))
        n = has.count() if cells is None else 0
        self.centres = fitted(m, cells or int(max(1, min(CELLS, 4 * n // TILE + 1)))) if self.dims else m


def tiles(df: DataFrame, pivots: Pivots, key: str, column: str) -> DataFrame:
    """Write df's rows as tile files; (path, cell, n, low, high) of those that the committed table lists."""
    spark, centres, dims = df.sparkSession, df.sparkSession.sparkContext.broadcast(pivots.centres), pivots.dims
    folder = scratch(spark, "tiles")
    make_dir(spark, folder)
    names = df.columns

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            m = unit(matrix(b.column(column)))
            a = np.concatenate([angles(m[k : k + 4096], centres.value) for k in range(0, len(m), 4096)]) if len(m) else np.zeros((0, 1))
            cell = a.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(a[np.arange(len(a)), cell])], [*b.schema.names, "_cell", "_angle"])

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        held: list[pa.RecordBatch] = []

        def put() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            angle = t.column("_angle").to_numpy()
            name = f"{uuid.uuid4().hex}.parquet"
            with store.open_output_stream(f"{path}/{name}") as f:
                pq.write_table(t.drop_columns(["_cell"]), f, compression="zstd")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "cell": pa.array([t.column("_cell")[0].as_py()], pa.int32()), "n": [t.num_rows], "low": [float(angle.min())], "high": [float(angle.max())]})

        for b in rows:
            cell = b.column("_cell").to_numpy()
            edges = np.flatnonzero(np.diff(cell, prepend=-1))
            for x, y in zip(edges, np.append(edges[1:], len(cell)), strict=True):
                while x < y:
                    n = sum(h.num_rows for h in held)
                    if held and (held[0].column("_cell")[0].as_py() != cell[x] or n >= TILE):
                        yield put()
                        held, n = [], 0
                    z = min(y, x + TILE - n)
                    held.append(b.slice(x, z - x))
                    x = z
        if held:
            yield put()

    kept = df.where((F.size(column) == dims) & (vector.dot(column, column) > 0)) if dims else df.where("false")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    placed = kept.mapInArrow(place, f"{ddl}, _cell int, _angle double") if dims else kept.withColumns({"_cell": F.lit(0), "_angle": F.lit(0.0)})
    placed = stored(placed, "placed")
    n = max(1, -(-placed.count() // TILE))
    cut = placed.repartitionByRange(n, "_cell", "_angle", key).sortWithinPartitions("_cell", "_angle", key)
    return stored(cut.select(*names, "_cell", "_angle").mapInArrow(write, "path string, cell int, n long, low double, high double"), "tiles")


def pairs(one: DataFrame, two: DataFrame, pivots: Pivots, most: float, within: bool) -> DataFrame:
    """Pairs of tiles that may hold rows within the angle `most`; within: of one table with itself, each pair once."""
    spark, c = one.sparkSession, pivots.centres
    radius = lambda t: {r.cell: r.r for r in t.groupBy("cell").agg(F.max("high").alias("r")).collect()}  # noqa: E731  CELLS rows at most
    r1, r2 = (np.array([found.get(k, -np.inf) for k in range(len(c))]) for found in (radius(one), radius(two)))
    d = angles(c, c) if len(c) else np.zeros((0, 0))
    i, j = np.nonzero(d - r1[:, None] - r2[None, :] <= most + SLACK)
    cells = spark.createDataFrame(pa.table({"cell_one": pa.array(i, pa.int32()), "cell_two": pa.array(j, pa.int32()), "apart": d[i, j]}))  # CELLS squared at most
    named = lambda t, s: t.select(*(F.col(x).alias(f"{x}_{s}") for x in t.columns))
    met = named(one, "one").join(cells, "cell_one").join(named(two, "two"), "cell_two")
    for least, far in (("apart - high_one - high_two", ""), ("low_one - apart - high_two", ""), ("low_two - apart - high_one", "")):
        met = met.where(f"{least} <= {most + SLACK}{far}")
    return met.where("path_one <= path_two") if within else met


#: For two tables of rows and the places and cosines of the pairs that are near enough, what to report.
Report = Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray, bool], dict[str, pa.Array | np.ndarray]]


def compared(met: DataFrame, pivots: Pivots, column: str, least: float, report: Report, schema: str) -> DataFrame:
    """Read each pair of tiles and report its pairs of rows with a cosine of `least` or more; and how many pairs were multiplied, in a
    row whose `multiplied` is not null. schema: the report's columns, by name."""
    spark = met.sparkSession
    told = spark.sparkContext.broadcast(pivots.centres)
    most = float(np.arccos(np.clip(least, -1, 1))) + SLACK
    names = [x.split()[0] for x in schema.split(", ")]

    def read(uri: str) -> pa.Table:
        store, path = store_of(uri)
        with store.open_input_file(path) as f:
            return pq.read_table(f)

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = told.value
        for b in rows:
            for r in b.to_pylist():
                alone = r["path_one"] == r["path_two"]
                x = read(r["path_one"])
                y = x if alone else read(r["path_two"])
                p, q = unit(matrix(x.column(column))), unit(matrix(y.column(column)))
                i, j = np.arange(len(p)), np.arange(len(q))
                if r["cell_one"] != r["cell_two"]:
                    a = angles(p, c[r["cell_two"]][None])[:, 0]
                    i = i[(a >= r["low_two"] - most) & (a <= r["high_two"] + most)]
                    a = angles(q, c[r["cell_one"]][None])[:, 0]
                    j = j[(a >= r["low_one"] - most) & (a <= r["high_one"] + most)]
                s = p[i] @ q[j].T
                u, v = np.nonzero(s >= least)
                if alone:
                    u, v = u[u < v], v[u < v]
                out = report(x, y, i[u], j[v], s[u, v], alone)
                n = len(next(iter(out.values())))
                for k in range(0, n, 50_000):
                    yield pa.RecordBatch.from_arrays([*(pa.array(out[m])[k : k + 50_000] for m in names), pa.nulls(min(n - k, 50_000), pa.int64())], [*names, "multiplied"])
                nulls = [pa.nulls(1, pa.array(out[m]).type) for m in names]
                yield pa.RecordBatch.from_arrays([*nulls, pa.array([len(i) * len(j) // (2 if alone else 1)], pa.int64())], [*names, "multiplied"])

    spread = met.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "path_one", "path_two")
    return spread.select("path_one", "path_two", "cell_one", "cell_two", "low_one", "high_one", "low_two", "high_two").mapInArrow(meet, f"{schema}, multiplied long")


def similar_pairs(df: DataFrame, least: float, key: str = "id", column: str = "embedding", cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) of all pairs a < b with a cosine of `least` or more, to six digits; and (multiplied,): how many were looked at."""
    v = df.where(F.col(column).isNotNull()).select(key, column)
    pivots = Pivots(v, key, column, cells)
    t = tiles(v, pivots, key, column)
    low = least - 1e-6
    kind = dict(df.dtypes)[key]

    def report(x: pa.Table, y: pa.Table, i: np.ndarray, j: np.ndarray, s: np.ndarray, alone: bool) -> dict:
        s = s.round(6)
        keep = s >= least
        a, b = (c.combine_chunks().take(pa.array(k[keep])) for c, k in ((x.column(key), i), (y.column(key), j)))
        less = pa.compute.less(a, b)
        other = pa.compute.not_equal(a, b)
        a, b = pa.compute.if_else(less, a, b), pa.compute.if_else(less, b, a)
        return {"a": a.filter(other), "b": b.filter(other), "similarity": pa.array(s[keep]).filter(other)}

    found = compared(pairs(t, t, pivots, float(np.arccos(np.clip(low, -1, 1))), True), pivots, column, low, report, f"a {kind}, b {kind}, similarity double")
    return found.where("multiplied IS NULL").drop("multiplied"), found.where("multiplied IS NOT NULL").select("multiplied")
