"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, as in tests, a folder of this machine, but only if the master is this machine.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="memloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage with a table written in the shared folder; unlike a local checkpoint it outlives its executors."""
    spark, to = df.sparkSession, scratch(df.sparkSession, name)
    df.write.options(**options).parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def make_dir(spark: SparkSession, path: str) -> None:
    """Make a folder of the shared store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared path as an executor's Python sees it, and the path in it."""
    if "://" not in uri:
        uri = "file://" + uri if not uri.startswith("file:") else "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession) -> None:
    """Batches of bounded bytes between the JVM and Python, unless the session says otherwise: rows here may hold megabytes."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


def _give_back() -> None:
    """Return freed memory to the system: Arrow's pool, and the C library's heap where it can."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: large arrays are maps of their own, gone when freed
        libc.malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for a worker that serves many tasks: what a task has freed isn't held through the next."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        try:
            yield from f(rows)
        finally:
            _give_back()

    return run


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_parts(n_bytes: int, each: int, least: int, most: int = 100_000) -> int:
    """Parts of about `each` bytes: the count grows with the input, never below `least`; past `most` the parts grow instead."""
    return max(least, min(most, -(-n_bytes // each)))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def crc(text: str) -> int:
    """A hash of a string that is the same in every process."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Gather small record batches to tables of about most_bytes."""
    held, size = [], 0
    for b in rows:
        held.append(b)
        size += b.nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def slices(sizes: np.ndarray, most: int) -> Iterable[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about `most`, one item at least."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, one cheap scan."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def plan_bytes(df: DataFrame) -> int:
    """Bytes that a plan's tables have as files, without a pass over the rows; for tables of unknown size, a pass."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return n if n < 1 << 60 else total_bytes(df)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; MEMLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("MEMLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def running_totals(df: DataFrame, key: str, value: str, group: Column) -> DataFrame:
    """(key, before): the sum of the values at smaller keys. `group` rises with the key; sums run within groups and then over them."""
    df = df.select(F.col(key), F.col(value), group.alias("_group"))
    groups = df.groupBy("_group").agg(F.sum(value).alias("_all"))
    groups = groups.select("_group", (F.sum("_all").over(Window.orderBy("_group")) - F.col("_all")).alias("_base"))
    within = Window.partitionBy("_group").orderBy(key)
    return df.withColumn("_own", F.sum(value).over(within) - F.col(value)).join(groups, "_group").select(key, (F.col("_own") + F.col("_base")).alias("before"))
