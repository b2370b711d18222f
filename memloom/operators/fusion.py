"""Combining ranked lists: weighted sums, reciprocal ranks, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import decay


def _one(df: DataFrame, *aggs: Column) -> DataFrame:
    return F.broadcast(df.agg(*aggs))  # one row


def composite(near: DataFrame, limit: int) -> DataFrame:
    """The nearest 3 * limit rows, scored importance * .4 + (1 - d / max d) * .6, best `limit`."""
    c = near.orderBy("distance", "id").limit(3 * limit).withColumn("m", F.max("distance").over(Window.partitionBy(F.lit(0))))  # a bounded list
    s = F.col("importance") * 0.4 + F.when(F.col("m") > 0, 1 - F.col("distance") / F.col("m")).otherwise(1.0) * 0.6
    return c.withColumn("score", F.round(s, 6)).drop("m").orderBy(F.desc("score"), "id").limit(limit)


def min_max(df: DataFrame, column: str, high_first: bool) -> DataFrame:
    """(id, value scaled to [0, 1], best 1); a list of equal values is all 1."""
    s = _one(df, F.min(column).alias("lo"), F.max(column).alias("hi"))
    scaled = (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    v = F.when(F.col("hi") > F.col("lo"), scaled if high_first else 1 - scaled).otherwise(1.0)
    return df.crossJoin(s).select("id", v.alias(column))


def relative_score(vector: DataFrame, lexical: DataFrame, alpha: float, limit: int | None) -> DataFrame:
    """alpha * scaled vector score + (1 - alpha) * scaled lexical score, over the union of ids; without a limit, all of them unordered."""
    v, b = min_max(vector.select("id", "distance"), "distance", False), min_max(lexical.select("id", "score"), "score", True)
    both = v.withColumnRenamed("distance", "v").join(b.withColumnRenamed("score", "b"), "id", "full_outer")
    score = alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0))
    scored = both.select("id", F.round(score, 6).alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)


def recall(vector: DataFrame, lexical: DataFrame, ages: DataFrame, ref: Column, limit: int, compat: bool = False) -> DataFrame:
    """.30 lexical + .60 vector + .10 time, over the union of two lists of 2 * limit.

    Lexical scores are divided by their maximum; a row of the vector list alone gets half their mean, a row of the lexical list alone
    no vector score. compat: the time score is .5 for all.
    """
    v = vector.orderBy("distance", "id").limit(2 * limit).select("id", (1 - F.col("distance")).alias("v"))
    b = lexical.orderBy(F.desc("score"), "id").limit(2 * limit)
    every = Window.partitionBy(F.lit(0))  # over bounded lists
    m = F.max("score").over(every)
    b = b.select("id", F.when(m > 0, F.least(F.col("score") / m, F.lit(1.0))).otherwise(0.0).alias("b"))
    both = v.join(b, "id", "full_outer").withColumn("mean", F.coalesce(F.avg("b").over(every), F.lit(0.0)))
    both = ages.join(F.broadcast(both), "id", "right")  # at most 4 * limit rows
    t = F.lit(0.5) if compat else decay.recall_time(F.col("ts"), ref)
    score = 0.3 * F.coalesce("b", 0.5 * F.col("mean")) + 0.6 * F.coalesce("v", F.lit(0.0)) + 0.1 * t
    return both.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Ranks from 1 within a list that a limit has bounded."""
    return df.select("id", F.row_number().over(Window.orderBy(*order, "id")).alias("rank"))


def reciprocal_rank(lists: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over ranked lists (id, rank), with each list's rank."""
    both = None
    for name, df in lists.items():
        one = df.select("id", F.lit(name).alias("list"), "rank")
        both = one if both is None else both.unionByName(one)
    ranks = [F.max(F.when(F.col("list") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists]
    return both.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), *ranks)


def rerank(candidates: DataFrame, ref: Column, k: int, importance_weight: float = 0.3, factor: float = 0.1) -> DataFrame:
    """similarity * (1 - w) + importance * w + .2 * exp(-factor * days / 30), best k; candidates have similarity, importance, ts, content."""
    t = decay.rerank_time(F.col("ts"), ref, factor)
    s = F.col("similarity") * (1 - importance_weight) + F.col("importance") * importance_weight + 0.2 * t
    return candidates.where("content IS NOT NULL AND content <> ''").withColumn("score", F.round(s, 6)).orderBy(F.desc("score"), "id").limit(k)
