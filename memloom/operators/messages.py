"""Sessions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import text as fn
from memloom.operators import scan


def imported(msg: DataFrame, least: int = 10) -> DataFrame:
    """Messages of users and assistants with `least` characters or more that aren't acknowledgements."""
    t = fn.stripped("content")
    return msg.where(F.col("role").isin("user", "assistant") & (F.length(t) >= least) & ~t.rlike(fn.ACKS))


def titles(msg: DataFrame) -> DataFrame:
    """A session's title from its first user message, with its number of messages."""
    users = F.when(F.col("role") == "user", F.col("turn"))
    g = msg.groupBy("session_id").agg(F.min_by("content", users).alias("first"), F.count("*").alias("messages"))
    return g.select("session_id", "messages", fn.title(F.col("first")).alias("title"))


def blocks(msg: DataFrame, cut: int = 500, least: int = 30) -> DataFrame:
    """Question and answer: a block ends at each assistant message. Texts are cut; short blocks go.

    A message's block is the number of assistant messages at smaller turns of its session, summed stretch by stretch, so that a session of
    any length is many tasks. Equal turns share a block, in the order of their lines. What a task holds is a block.
    """
    said = msg.where(F.col("role").isin("user", "assistant"))
    before = scan.running_before(said, "session_id", "turn", (F.col("role") == "assistant").cast("int"), "block")
    line = F.concat_ws(": ", "role", F.substring("content", 1, cut))
    held = said.join(before, ["session_id", "turn"]).withColumn("block", F.col("block").cast("int")).groupBy("session_id", "block")
    out = held.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("messages"))
    return out.where(F.length("text") >= least)


def batch_unique(msg: DataFrame, *group: str) -> DataFrame:
    """The first of equal contents in a batch, by hash; an aggregate, not a gathered group."""
    h = F.substring(F.md5(F.coalesce("content", F.lit(""))), 1, 16).alias("hash")
    return msg.groupBy(*group, h).agg(F.min("turn").alias("turn"), F.count("*").alias("copies"))


def session_unique(msg: DataFrame) -> DataFrame:
    """One row for each role and first hundred characters in a session."""
    return msg.groupBy("session_id", "role", F.substring("content", 1, 100).alias("head")).agg(F.min("turn").alias("turn"))
