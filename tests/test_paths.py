"""Searches of any depth against breadth-first search in plain Python."""

import random
from collections import defaultdict

import pytest

from memloom.operators import graph


def bfs(edges, start, directed):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        if not directed:
            out[b].add(a)
    dist, order = {start: 0}, [start]
    for x in order:
        for y in sorted(out[x]):
            if y not in dist:
                dist[y] = dist[x] + 1
                order.append(y)
    return dist, out


def all_paths(edges, start, end, most, directed):
    dist, out = bfs(edges, start, directed)
    if start == end or dist.get(end, most + 1) > most:
        return []
    paths = [[start]]
    for d in range(dist[end]):
        paths = [[*p, y] for p in paths for y in out[p[-1]] if dist[y] == d + 1]
    return sorted((dist[end], p) for p in paths if p[-1] == end)


@pytest.mark.parametrize(("seed", "directed"), [(0, False), (1, True)])
def test_paths_are_breadth_first(spark, seed, directed):
    r = random.Random(seed)
    edges = {(f"n{a}", f"n{min(39, max(0, a + r.randint(-3, 3)))}") for a in range(40) for _ in range(2)} | {("x", "y"), ("n3", "n3")}
    kg = spark.createDataFrame([(a, "r", b, 1.0) for a, b in edges], "source string, relation string, target string, confidence double")
    dist, _ = bfs(edges, "n1", directed)
    assert {x.name: x.distance for x in graph.k_hop(kg, "n1", 30, directed).collect()} == {k: d for k, d in dist.items() if d}
    far = max((k for k in dist if k != "n1"), key=lambda k: (dist[k], k))
    for end, most in ((far, 30), (far, 2), ("x", 30), ("n1", 5), ("absent", 5)):
        assert sorted((x.hops, x.path) for x in graph.shortest_paths(kg, "n1", end, most, directed).collect()) == all_paths(edges, "n1", end, most, directed)


def test_dead_ends_are_not_followed(spark):
    """A long chain beside a bushy hub: only edges of shortest paths are put together."""
    edges = [(f"c{k}", f"c{k + 1}") for k in range(12)] + [("c0", f"leaf{k}") for k in range(300)]
    kg = spark.createDataFrame([(a, "r", b, 1.0) for a, b in edges], "source string, relation string, target string, confidence double")
    got = graph.shortest_paths(kg, "c0", "c12", 12).collect()
    assert [(x.hops, x.path) for x in got] == [(12, [f"c{k}" for k in range(13)])]
