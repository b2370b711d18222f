"""Joins and top lists that no key can make uneven: keys are told apart by size, and large ones are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.shared import stored

#: Rows of a side that meet in one task for a heavy key, and keys that may be broadcast.
SIDE, BROADCAST = 2000, 200_000


def product_join(a: DataFrame, b: DataFrame, keys: list[str], spread_a: str, spread_b: str, side: int = SIDE) -> DataFrame:
    """The inner join of a and b, whose other columns have different names; null keys match nothing.

    A key with more than side * side pairs is heavy: its rows go to a grid of tasks, a row of `a` to one line and all its columns, a row of `b`
    to one column and all its lines, by hashes of their spread columns. Each pair of rows meets once. Other keys join as ever.
    """
    sizes = a.groupBy(*keys).agg(F.count("*").alias("_na")).join(b.groupBy(*keys).agg(F.count("*").alias("_nb")), keys)
    heavy = sizes.where(F.col("_na").cast("double") * F.col("_nb") > float(side) * side)
    heavy = stored(heavy.select(*keys, F.ceil(F.col("_na") / side).cast("int").alias("_lines"), F.ceil(F.col("_nb") / side).cast("int").alias("_columns")), "heavy")
    n = heavy.count()
    if not n:
        return a.join(b, keys)
    heavy = F.broadcast(heavy) if n <= BROADCAST else heavy
    light = a.join(heavy.select(*keys), keys, "left_anti").join(b.join(heavy.select(*keys), keys, "left_anti"), keys)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    x = a.join(heavy, keys).withColumn("_line", part(spread_a, "_lines")).withColumn("_column", every("_columns")).drop("_lines", "_columns")
    y = b.join(heavy, keys).withColumn("_column", part(spread_b, "_columns")).withColumn("_line", every("_lines")).drop("_lines", "_columns")
    return light.unionByName(x.join(y, [*keys, "_line", "_column"]).drop("_line", "_column"))


def top_per(df: DataFrame, keys: list[str], k: int | Column, order: list[Column], spread: str, rank: str = "rank", salt: int = 16) -> DataFrame:
    """The first k rows of each key by an order without ties, numbered; a key's rows are first ranked in `salt` parts, and only k of each meet."""
    w = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salt))).withColumn(rank, w(*keys, "_salt")).where(F.col(rank) <= k).drop("_salt", rank)
    return some.withColumn(rank, w(*keys)).where(F.col(rank) <= k)
