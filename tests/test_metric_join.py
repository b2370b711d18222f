"""The metric join against all pairs, and how many pairs it multiplies."""

import numpy as np
import pytest

from memloom.operators import metric_join
from memloom.operators.vector_index import unit
from tests.test_vector_index import clustered


def brute(m, least):
    u = unit(m.astype(np.float64))
    s = (u @ u.T).round(6)
    i, j = np.nonzero(np.triu(s >= least, 1))
    ok = m.any(axis=1)
    return sorted((int(a), int(b), float(s[a, b])) for a, b in zip(i, j, strict=True) if ok[a] and ok[b])


def found(df, *args, **more):
    pairs, seen = metric_join.similar_pairs(df, *args, **more)
    return sorted((r.a, r.b, r.similarity) for r in pairs.collect()), seen.agg({"multiplied": "sum"}).first()[0]


def frame(spark, m):
    return spark.createDataFrame([(k, x.tolist(), 1.0) for k, x in enumerate(m)], "id long, embedding array<float>, low double").repartition(4)


@pytest.mark.parametrize(("noise", "least", "tile"), [(0.06, 0.95, 50), (0.3, 0.8, 2000), (5.0, 0.35, 30), (5.0, -0.5, 64)])
def test_pairs_are_brute_force(spark, noise, least, tile, monkeypatch):
    monkeypatch.setattr(metric_join, "TILE", tile)
    m = clustered(3, 400, noise=noise)
    m[5], m[100], m[101] = 0, m[0], m[0]
    got, _ = found(frame(spark, m), least)
    want = brute(m, least)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want], abs=2e-6)


def test_few_pairs_are_multiplied(spark, monkeypatch):
    """Clustered vectors: under a tenth of all pairs are looked at."""
    monkeypatch.setattr(metric_join, "TILE", 50)
    m = clustered(4, 3000)
    got, seen = found(frame(spark, m), 0.97)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(m, 0.97)]
    assert seen < 0.1 * len(m) * (len(m) - 1) / 2


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0, 0.0, 0.0])], "id long, embedding array<float>")
    assert found(df, 0.9)[0] == [(3, 4, 1.0)]
    assert found(df.where("false"), 0.9) == ([], None)
