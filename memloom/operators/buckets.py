"""Tables that change in part: rows lie in hash buckets of their key, and a change rewrites only buckets that it really changes.

A bucket is a partition folder. A batch of changes finds its buckets by hash, reads just those, and replaces them by dynamic partition
overwrite; the files of all others keep their names. Changes to nothing rewrite nothing. One writer at a time, as for any Parquet table
without a log: a batch that is run again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.shared import stored


class BucketTable:
    """A table in a folder that driver and executors share. Rows of one key lie together; a key may have many rows. Null keys are a key."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = 64) -> BucketTable:
        self = cls(df.sparkSession, path, key)
        df.limit(0).withColumn("n_buckets", F.lit(buckets)).write.parquet(f"{self.path}/columns")
        self.spark.createDataFrame([(buckets,)], "n int").coalesce(1).write.parquet(f"{self.path}/buckets")
        self._write(df.withColumn("_bucket", self._bucket(buckets)))
        return self

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _n(self) -> int:
        return self.spark.read.parquet(f"{self.path}/buckets").first().n

    def _write(self, rows: DataFrame) -> None:
        spread = rows.hint("rebalance", "_bucket")  # a large bucket is several files
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/columns").drop("n_buckets").schema.add("_bucket", "integer")
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        return rows if buckets is None else rows.where(F.col("_bucket").isin(buckets) if buckets else F.lit(False))

    def rows(self) -> DataFrame:
        return self._rows().drop("_bucket")

    def get(self, *keys) -> DataFrame:
        """All rows of some keys, from their buckets alone."""
        n = self._n()
        named = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {dict(self.rows().dtypes)[self.key]}")
        found = [r[0] for r in named.select(self._bucket(n)).distinct().collect()]  # n at most
        return self._rows(found).drop("_bucket").join(F.broadcast(named), self.key, "left_semi")  # the keys given

    def delete(self, keys: DataFrame) -> int:
        """Take out all rows of the keys; the number of buckets rewritten."""
        return self._change(keys.select(self.key).distinct(), None)

    def replace(self, new: DataFrame) -> int:
        """Put the rows of new in place of all rows of their keys; the number of buckets rewritten."""
        return self._change(new.select(self.key).distinct(), new)

    def patch(self, changes: DataFrame) -> int:
        """Put columns of `changes` (one row for each key) into the rows of their keys where they aren't null; other keys are not added."""
        cols = [c for c in changes.columns if c != self.key]
        mine = changes.select(F.col(self.key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in cols))
        n = self._n()
        touched = self._touched(changes.select(self.key).distinct(), n)
        held = self._rows(touched).join(mine, F.col(self.key).eqNullSafe(F.col("_k")), "left")
        kept = [c for c in self._rows().columns]
        return self._put(held.select(*(F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in kept)), touched)

    def _touched(self, keys: DataFrame, n: int, new: bool = False) -> list[int]:
        """Buckets that hold one of the keys, and with `new` those that would."""
        named = keys.withColumn("_bucket", self._bucket(n))
        asked = [r[0] for r in named.select("_bucket").distinct().collect()]  # n at most
        if new:
            return asked
        held = self._rows(asked).select(self.key, "_bucket").join(named.select(F.col(self.key).alias("_k"), F.col("_bucket").alias("_b")), (F.col(self.key).eqNullSafe(F.col("_k"))) & (F.col("_bucket") == F.col("_b")), "left_semi")
        return [r[0] for r in held.select("_bucket").distinct().collect()]

    def _change(self, keys: DataFrame, new: DataFrame | None) -> int:
        n = self._n()
        keys = stored(keys, "keys")
        touched = self._touched(keys, n, new is not None)
        left = self._rows(touched).join(keys.select(F.col(self.key).alias("_k")), F.col(self.key).eqNullSafe(F.col("_k")), "left_anti")
        if new is not None:
            left = left.unionByName(new.select(*(c for c in left.columns if c != "_bucket")).withColumn("_bucket", self._bucket(n)))
        return self._put(left, touched)

    def _put(self, rows: DataFrame, touched: list[int]) -> int:
        if not touched:
            return 0
        rows = stored(rows, "buckets")  # a table can't be read while it is overwritten
        full = {r[0] for r in rows.select("_bucket").distinct().collect()}  # n at most
        self._write(rows)
        for b in set(touched) - full:  # nothing is written for a bucket that has become empty
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/_bucket={b}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return len(touched)
