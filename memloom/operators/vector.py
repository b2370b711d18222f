"""Exact vector search with array expressions: no Python in the hot path, one pass, a bounded top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    """A query's vector as a constant."""
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a norm is 0, null where a vector is null. Vectors of unequal length give null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms > 0, dot(a, b) / norms).otherwise(0.0))


def with_distance(df: DataFrame, vector: list[float], column: str = "embedding") -> DataFrame:
    """df with `distance` = 1 - cosine, to six digits; rows without a vector go."""
    return df.where(F.col(column).isNotNull()).withColumn("distance", F.round(1 - cosine(F.col(column), literal(vector)), 6)).drop(column)


def top_k(df: DataFrame, k: int, *order: Column | str, tie: str = "id") -> DataFrame:
    """First k by the order, ties by id: TakeOrderedAndProject keeps k rows a task."""
    return df.orderBy(*order, tie).limit(k)
