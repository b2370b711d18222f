"""Knowledge-base search over chunks, grouped to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_vector(hits: DataFrame, limit: int) -> DataFrame:
    """Documents of the nearest 2 * limit chunks (document_id, distance), by their best 1 / (1 + distance)."""
    near = hits.orderBy("distance", "document_id").limit(2 * limit)
    return near.groupBy("document_id").agg(F.round(F.max(1 / (1 + F.col("distance"))), 6).alias("score"))


def by_rank(hits: DataFrame, limit: int) -> DataFrame:
    """Documents of the best 2 * limit chunks (document_id, chunk_index, score), by their best 1 / rank."""
    best = hits.orderBy(F.desc("score"), "document_id", "chunk_index").limit(2 * limit)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "document_id", "chunk_index")))  # a bounded list
    return ranked.groupBy("document_id").agg(F.round(F.max(1 / F.col("rank")), 6).alias("score"), F.array_sort(F.collect_list("chunk_index")).alias("chunks"))


def fused(vector: DataFrame, lexical: DataFrame, limit: int, weight: float = 0.6) -> DataFrame:
    """weight * v / max v + (1 - weight) * b / max b over the union of two short lists."""
    most = F.max("score").over(Window.partitionBy(F.lit(0)))  # over a bounded list
    top = lambda d, n: d.withColumn("_m", most).select("document_id", F.when(F.col("_m") > 0, F.col("score") / F.col("_m")).otherwise(0.0).alias(n))
    both = top(vector.select("document_id", "score"), "v").join(top(lexical.select("document_id", "score"), "b"), "document_id", "full_outer")
    score = weight * F.coalesce("v", F.lit(0.0)) + (1 - weight) * F.coalesce("b", F.lit(0.0))
    return both.select("document_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "document_id").limit(limit)
