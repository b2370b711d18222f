"""Session logs: JSON lines, one file a session, as batch or stream.

A line is {type, id, timestamp, message: {role, content}}; content is a text or an array of parts {type, text}. Blank and broken lines,
other types and other roles are skipped. Files that were deleted or are being written are left out; copies kept at a reset count as
sessions of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text as fn

PARTS = "array<struct<type:string,text:string>>"
LINE = "type string, id string, timestamp string, message struct<role:string,content:string>"
#: Fixed value: the notice that opens a session.
NOTICE = "A new session was started"


def content_text(content: Column) -> Column:
    """The text of a message: its text parts, cleaned, a line each; other parts and notices are left out."""
    parts = F.from_json(content, PARTS)
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & ~F.coalesce(p["text"].startswith(NOTICE), F.lit(False))), lambda p: fn.clean_metadata(F.coalesce(p["text"], F.lit(""))))
    joined = F.array_join(F.filter(texts, lambda x: x != ""), "\n")
    return F.when(F.ltrim(content).startswith("["), joined).otherwise(fn.clean_metadata(content))


def parsed(lines: DataFrame) -> DataFrame:
    """(session_id, unique_id, is_reset, id, role, content, timestamp) from (value, path)."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    j = F.from_json("value", LINE)
    d = lines.withColumn("name", name).where(~F.col("name").rlike(r"\.deleted\.|\.tmp")).where(F.length(F.trim("value")) > 0).withColumn("j", j)
    reset = F.col("name").contains(".jsonl.reset.")
    session = F.when(reset, F.split("name", r"\.jsonl\.reset\.")[0]).otherwise(F.regexp_replace("name", r"\.jsonl$", ""))
    unique = F.when(reset, F.concat(session, F.lit("_reset_"), F.substring(F.split("name", r"\.jsonl\.reset\.")[1], 1, 10))).otherwise(session)
    d = d.where((F.col("j.type") == "message") & F.col("j.message.role").isin("user", "assistant"))
    d = d.select(session.alias("session_id"), unique.alias("unique_id"), reset.alias("is_reset"), F.col("j.id").alias("id"), F.col("j.message.role").alias("role"), fn.clean_message(content_text(F.col("j.message.content"))).alias("content"), F.col("j.timestamp").alias("timestamp"))
    return d.where("content <> ''")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", "*.jsonl*").option("recursiveFileLookup", "true").text(path)
    return parsed(raw.select("value", F.col("_metadata.file_path").alias("path")))


def after(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Messages of each session behind the last one seen (unique_id, last_timestamp); sessions not yet seen pass whole."""
    return messages.join(seen, "unique_id", "left").where("last_timestamp IS NULL OR timestamp > last_timestamp").drop("last_timestamp")


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified) of the session file that changed last; only the listing is read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path).select("path", "modificationTime")
    return f.agg(F.max_by("path", "modificationTime").alias("path"), F.max("modificationTime").alias("modified"))


def active_session(index: DataFrame, files: DataFrame) -> DataFrame:
    """(agent, source, path): which file each agent's session is followed in.

    index: (agent, session_id, session_file, updated_ms) as the agents' index files say; files: (agent, path, modified_ms), the listing.
    The index's file counts if it is at least as new as the agent's newest file, and is there; else the newest file, the last by name of
    equally new ones. Deleted, unfinished and locked files don't count. Agents without files have none. One row for each agent.
    """
    here = files.where(~F.regexp_extract("path", r"([^/]+)$", 1).rlike(r"\.deleted\.|\.tmp|\.lock"))
    newest = here.groupBy("agent").agg(F.max(F.struct("modified_ms", "path")).alias("f"))
    said = index.groupBy("agent").agg(F.max(F.struct("updated_ms", "session_id", "session_file")).alias("i"))
    there = files.select(F.col("agent").alias("_a"), F.col("path").alias("_p")).distinct()
    j = said.join(newest, "agent", "full_outer").join(there, (F.col("agent") == F.col("_a")) & (F.col("i.session_file") == F.col("_p")), "left")
    indexed = (F.col("i.session_id") != "") & (F.col("i.updated_ms") >= F.col("f.modified_ms")) & F.col("_p").isNotNull()
    source = F.when(F.col("f").isNull(), "none").when(F.coalesce(indexed, F.lit(False)), "index").otherwise("newest")
    return j.select("agent", source.alias("source"), F.when(source == "index", F.col("i.session_file")).otherwise(F.col("f.path")).alias("path"))


def index_rows(spark: SparkSession, path: str) -> DataFrame:
    """(agent, session_id, session_file, updated_ms) from index files of the form {"agent:a:a": {sessionId, updatedAt, sessionFile}}."""
    raw = spark.read.option("wholetext", "true").text(path)
    m = F.from_json("value", "map<string,struct<sessionId:string,updatedAt:bigint,sessionFile:string>>")
    e = raw.select(F.explode(F.map_entries(m)).alias("e"))
    return e.select(F.regexp_extract("e.key", r"^agent:([^:]*)", 1).alias("agent"), F.col("e.value.sessionId").alias("session_id"), F.col("e.value.sessionFile").alias("session_file"), F.col("e.value.updatedAt").alias("updated_ms"))
