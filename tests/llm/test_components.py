"""Connected components against union-find."""

import random

import pytest

from memloom.llm.components import components


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (None, 4)], [(i, i + 1) for i in range(40)], "random"])
def test_components(spark, edges):
    r = random.Random(7)
    edges = [(r.randint(-40, 60), r.randint(-40, 60)) for _ in range(70)] if edges == "random" else edges
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((g.node, g.root) for g in got) == sorted((x, find(x)) for x in root)
