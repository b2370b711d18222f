"""Incremental ingest of session logs into the memory table.

The source's offsets (the lengths of the session files) are the change detection, and ids are hashes of session and message, so a batch that is written twice
changes nothing: each batch is anti-joined with the ids already held. Batches are flushed by the trigger; `backfill` runs all that is
there and stops. A failed enrichment leaves a memory as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memloom.functions import text as fn
from memloom.sources import session_tail, sessions

MEMORY = "id string, session_id string, role string, content string, summary string, importance double, quality string, memory_type string, source string, ts timestamp"


def memories(messages: DataFrame) -> DataFrame:
    """Messages to memories: exact copies in the batch once, low quality left out, summary and defaults put in."""
    first = messages.groupBy(F.substring(F.md5("content"), 1, 16).alias("hash")).agg(F.min(F.struct("timestamp", "unique_id", "id", "session_id", "role", "content")).alias("m")).select("m.*")
    score = fn.quality_short("content", "role")
    good = first.withColumn("score", score).where("score >= 0.4")
    ts = F.try_to_timestamp(F.regexp_replace("timestamp", "Z$", "+00:00"))
    return good.select(F.md5(F.concat_ws(":", "unique_id", "id")).alias("id"), "session_id", "role", "content", fn.summary("content").alias("summary"), F.lit(0.5).alias("importance"), fn.grade(F.col("score")).alias("quality"), F.lit("conversation").alias("memory_type"), F.lit("session_sync").alias("source"), ts.alias("ts"))


def append(batch: DataFrame, table: str) -> int:
    """Append what the table doesn't hold yet; the number of rows added."""
    spark = batch.sparkSession
    held = spark.read.schema(f"{MEMORY}, {HASHED}").parquet(table) if _exists(spark, table) else spark.createDataFrame([], f"{MEMORY}, {HASHED}")
    new = batch.withColumn("hash", F.md5("content")).withColumn("part", F.conv(F.substring("hash", 1, 2), 16, 10).cast("int"))
    # a text's hash lies in one part of the table: no stored text is read, and hashes of those parts only that the batch has
    parts = [r[0] for r in new.select("part").distinct().collect()]  # 256 at most
    met = held.where(F.col("part").isin(parts)).select("part", "hash") if parts else held.select("part", "hash")
    new = new.join(met, ["part", "hash"], "left_anti").join(held.select("id"), "id", "left_anti").select(*(x.split()[0] for x in MEMORY.split(", ")), "hash", "part").persist()
    n = new.count()
    if n:
        new.write.mode("append").partitionBy("part").parquet(table)
    new.unpersist()
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run(spark: SparkSession, source: str, table: str, checkpoint: str, seconds: int | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start the stream; every `seconds`, or once over all that is there. `after` sees each batch's messages (for graph extraction)."""

    def each(batch: DataFrame, k: int) -> None:
        append(memories(batch), table)
        if after is not None:
            after(batch, k)

    w = session_tail.stream_sessions(spark, source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(availableNow=True) if seconds is None else w.trigger(processingTime=f"{seconds} seconds")).start()


def backfill(spark: SparkSession, source: str, table: str) -> int:
    """The same by one batch job."""
    return append(memories(sessions.read_sessions(spark, source)), table)


HASHED = "hash string, part int"
FLUSHED = "unique_id string, n long, last_id string, contents array<string>"


def flushes(messages: DataFrame, least: int = 3, wait_ms: int = 30_000) -> DataFrame:
    """Pending messages of each session, given out when there are `least`, or when `wait_ms` have passed without more."""

    def step(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pending = state.get if state.exists else ("", [])
        pending = list(pending)
        for p in pages:
            p = p.sort_values("timestamp")
            pending += p["content"].tolist()
            last = p["id"].iloc[-1] if len(p) else last
        if pending and (len(pending) >= least or state.hasTimedOut):
            state.update((last, []))
            yield pd.DataFrame({"unique_id": [key[0]], "n": [len(pending)], "last_id": [last], "contents": [pending]})
            return
        state.update((last, pending))
        if pending:
            state.setTimeoutDuration(wait_ms)

    return messages.groupBy("unique_id").applyInPandasWithState(step, FLUSHED, "last_id string, pending array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def enriched(held: DataFrame, facts: DataFrame) -> DataFrame:
    """Memories with summary and importance from extracted facts (id, facts, importances); those without facts stay as they are."""
    f = facts.where(F.size("facts") > 0).select("id", F.array_join(F.slice("facts", 1, 3), "; ").alias("_s"), (F.aggregate("importances", F.lit(0.0), lambda a, x: a + x) / F.size("importances")).alias("_i"))
    return held.join(f, "id", "left").withColumns({"summary": F.coalesce("_s", "summary"), "importance": F.coalesce("_i", "importance")}).drop("_s", "_i")
