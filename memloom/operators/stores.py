"""Writes to the memory and triple tables, as whole-table rewrites: inserts, clears, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators import matcher
from memloom.operators.skew import top_per

#: Characters kept of a memory's raw conversation, and of its context.
RAW, CONTEXT = 10_000, 500


def memory_rows(new: DataFrame) -> DataFrame:
    """Rows as the store takes them: raw_conversation and context cut to their lengths; a missing vector stays null, never zeros."""
    return new.withColumns({"raw_conversation": F.substring(F.coalesce("raw_conversation", F.lit("")), 1, RAW), "context": F.substring(F.coalesce("context", F.lit("")), 1, CONTEXT)})


def triple_rows(new: DataFrame, now: Column) -> DataFrame:
    """(id, source, relation, target, ts): ids are hashes of the triple, so that a batch that is written twice changes nothing; ts defaults to now."""
    key = F.md5(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("\x00")) for c in ("source", "relation", "target"))))
    return new.select(key.alias("id"), "source", "relation", "target", F.coalesce("ts", now).alias("ts"))


def inserted(held: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """held with the rows of new whose key it lacks, the first of each key (by all columns)."""
    cols = [F.col(c) for c in new.columns]
    first = new.groupBy(key).agg(F.min(F.struct(*cols)).alias("_r")).select("_r.*")
    return held.unionByName(first.join(held.select(key), key, "left_anti"), allowMissingColumns=True)


#: The messages of a raw conversation.
MESSAGES = "array<struct<turn:bigint,role:string,content:string>>"


def found(memories: DataFrame, key: str, value, raw: str = "raw_conversation", to: str = "messages") -> DataFrame:
    """The memory with an id, whichever agent holds it, with its raw conversation as messages; null where that isn't JSON.

    The table is one for all agents, so that the id's predicate reaches the scan.
    """
    held = memories.where(F.col(key) == F.lit(value))
    return held.withColumn(to, F.from_json(F.when(F.try_parse_json(raw).isNotNull(), F.col(raw)), MESSAGES))


def is_entity(relation: Column) -> Column:
    """Entity rows have no relation, or one of those that writers give them."""
    return F.coalesce(relation, F.lit("")).isin("", "is_a", "is_entity")


def cleared(kg: DataFrame, entities: bool = False, relations: bool = False) -> DataFrame:
    """kg without its entity rows, its relation rows, or both."""
    gone = F.lit(False)
    if entities:
        gone = gone | is_entity(F.col("relation"))
    if relations:
        gone = gone | ~is_entity(F.col("relation"))
    return kg.where(~gone)


def imported(held: DataFrame, new: DataFrame, mode: str = "merge", key: str = "id", text: str = "content") -> DataFrame:
    """held after an import. merge: rows with a text that isn't held yet come in, one of each text. overwrite: the import takes held's place.

    Rows without a text are left out in both modes. Texts meet by their hash; no group of equal texts is gathered.
    """
    if mode not in ("merge", "overwrite"):
        raise ValueError("mode is merge or overwrite")
    h = F.sha2(F.col(text), 256)
    cols = [F.col(c) for c in new.columns]
    first = new.where(F.col(text) != "").groupBy(h.alias("_h")).agg(F.min_by(F.struct(*cols), F.struct(key)).alias("_r"))
    if mode == "overwrite":
        return first.select("_r.*")
    fresh = first.join(held.where(F.col(text) != "").select(h.alias("_h")), "_h", "left_anti").select("_r.*")
    return held.unionByName(fresh.join(held.select(key), key, "left_anti"), allowMissingColumns=True)


#: Contents of a session that the background stage reads, and the length that they must pass.
CONTENTS, LONGER = 5, 20


def background_entities(said: DataFrame, agent: Column) -> DataFrame:
    """(entity_id, name, type, confidence) from the first CONTENTS user contents of each session (session_id, turn, content) longer than
    LONGER characters: by the rules, once for each session; ids are agent, name and type."""
    long = said.where(F.length("content") > LONGER).withColumn("_agent", agent.cast("string"))
    first = top_per(long, ["session_id"], CONTENTS, [F.col("turn"), F.col("content")], "turn").select("_agent", "content")
    found = matcher.entities(first, "_agent", "content").select("_agent", "name", "type").distinct()
    return found.select(F.concat_ws("_", "_agent", "name", "type").alias("entity_id"), "name", "type", F.lit(0.7).alias("confidence"))
