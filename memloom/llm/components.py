"""Connected components of a graph of any size: alternating large-star and small-star steps.

Each step joins the edges with the smallest neighbour of one end and so shuffles as many rows as there are edges. After each
round the edges are written to the shared folder; rounds end when the edges are stars, after a number of rounds that grows with the
logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import stored


def _turned(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _stars(e: DataFrame) -> bool:
    """Is each edge (u, v), u > v, from a node with one edge to a node that has none downwards?"""
    twice = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    through = e.join(e.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").select("u")
    return twice.unionByName(through).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b); the root is the smallest node of the component. Nulls and loops are no edges."""
    e = stored(_turned(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _turned(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(_turned(small), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
