"""The stored vector index against brute force: exact search, recall of probed cells, rows read."""

import numpy as np
import pytest

from memloom.operators import vector_index
from memloom.operators.vector_index import VectorIndex, unit


def clustered(seed, n, groups=40, dims=16, noise=0.06):
    r = np.random.default_rng(seed)
    centres = unit(r.normal(size=(groups, dims)))
    return unit(centres[r.integers(0, groups, n)] + noise * r.normal(size=(n, dims))).astype(np.float32)


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + k, x.tolist(), f"p{k % 3}") for k, x in enumerate(m)], "id long, embedding array<float>, agent string")


def brute(m, q, k, keep=None):
    d = np.round(1 - unit(m.astype(np.float64)) @ unit(np.asarray([q], np.float64))[0], 6)
    d[~m.any(axis=1)] = 1.0
    ids = [i for i in range(len(m)) if keep is None or keep(i)]
    return sorted((float(d[i]), i) for i in ids)[:k]


def same(got, want):
    """Rows (distance, id): the same ids in the same order, at distances that agree to the last digit of rounding."""
    assert [i for _, i in got] == [i for _, i in want]
    assert [d for d, _ in got] == pytest.approx([d for d, _ in want], abs=2e-6)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    m = clustered(0, 3000)
    m[7] = 0
    return m, VectorIndex.build(frame(spark, m).repartition(5), f"file://{tmp_path_factory.mktemp('vectors')}/index")


def test_exact_search_is_brute_force(made):
    m, index = made
    for q in (m[3], m[7], m[100] + m[200], -m[5]):
        same([(r.distance, r.id) for r in index.search(q.tolist(), 10).collect()], brute(m, q, 10))
    got = index.search(m[3].tolist(), 10, where=vector_index.F.col("agent") == "p1").collect()
    same([(r.distance, r.id) for r in got], brute(m, m[3], 10, lambda i: i % 3 == 1))


def test_exact_search_reads_few_rows(made):
    """The scan of an exact search over clustered vectors is pruned to partitions with less than a tenth of the rows."""
    m, index = made
    cells = {r.cell: r.n for r in index.spark.read.parquet(f"{index.path}/cells").collect()}
    assert sum(cells[c] for c in index.cells_for(m[3].tolist(), 10)) < 0.1 * len(m)


def test_recall_of_probed_cells(spark, made):
    m, index = made
    asked = list(range(0, 3000, 100))
    q = frame(spark, m).where("id % 100 = 0").selectExpr("id AS query_id", "embedding")
    got = {}
    for r in index.search_many(q, 10, probe=4).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    hits = sum(len(got[i] & {j for _, j in brute(m, m[i], 10)}) for i in asked)
    assert hits / (10 * len(asked)) >= 0.95
    cells = [r.n for r in spark.read.parquet(f"{index.path}/cells").collect()]
    assert 4 * sum(c * c for c in cells) / sum(cells) < 0.1 * len(m)


@pytest.mark.parametrize("noise", [0.06, 5.0])
def test_many_exact_queries_are_brute_force(spark, tmp_path, noise, monkeypatch):
    """Also in blocks: a cell's rows and queries are dealt to several tasks."""
    monkeypatch.setattr(vector_index, "ROWS", 50)
    monkeypatch.setattr(vector_index, "QUERIES", 4)
    m = clustered(1, 600, noise=noise)
    m[11], m[500], m[501] = 0, m[0], m[0]
    index = VectorIndex.build(frame(spark, m), f"file://{tmp_path}/index", cells=12)
    q = frame(spark, m).where("id % 20 = 0 OR id = 11").selectExpr("id AS query_id", "embedding")
    got = {}
    for r in index.search_many(q, 7).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    assert len(got) == 31
    for i, rows in got.items():
        same(sorted(rows), brute(m, m[i], 7))


def test_insert_and_odd_rows(spark, tmp_path):
    m = clustered(2, 200)
    odd = spark.createDataFrame([(900, None, "x"), (901, [1.0, 2.0], "x"), (902, [0.0] * 16, "x")], "id long, embedding array<float>, agent string")
    index = VectorIndex.build(frame(spark, m[:150]).unionByName(odd), f"file://{tmp_path}/index")
    index.insert(frame(spark, m[150:], 150))
    assert index.rows().count() == 201
    same([(r.distance, r.id) for r in index.search(m[170].tolist(), 5).collect()], brute(m, m[170], 5))
    empty = VectorIndex.build(odd.where("false"), f"file://{tmp_path}/empty")
    assert empty.search(m[0].tolist(), 3).count() == 0
