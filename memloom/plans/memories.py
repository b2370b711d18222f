"""Duplicates, retention, changes, building memories, sessions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import text as fn
from memloom.operators import dedup, messages
from memloom.operators.shared import stored
from memloom.plans.registry import query
from memloom.plans.views import Tables


@query("SELECT id, kept FROM (SELECT id, min(id) OVER (PARTITION BY content) AS kept FROM mem) WHERE id > kept", "mem")
def dedup_exact(t: Tables) -> DataFrame:
    return dedup.exact_duplicates(t.mem())


_PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


def pairs(t: Tables, least: float) -> DataFrame:
    """The tables' vectors are random, so the plans ask for less than a store would (.85 and .95)."""
    return dedup.similar_pairs(t.base("embeddings").select(F.col("vec_id").alias("id"), "embedding"), least)


@query(f"SELECT a, b, similarity FROM ({_PAIRS}) WHERE similarity >= 0.35")
def dup_similar_pairs(t: Tables) -> DataFrame:
    return pairs(t, 0.35)


@query(f"SELECT b AS dropped, min(a) AS kept FROM ({_PAIRS}) WHERE similarity >= 0.45 GROUP BY b")
def dup_near(t: Tables) -> DataFrame:
    return dedup.keep_first(pairs(t, 0.45))


@query(f"SELECT CASE WHEN x.importance >= y.importance THEN a ELSE b END AS keep, CASE WHEN x.importance >= y.importance THEN b ELSE a END AS gone, similarity FROM ({_PAIRS}) JOIN mem x ON x.id = a JOIN mem y ON y.id = b WHERE similarity >= 0.35", "mem")
def dup_consolidate(t: Tables) -> DataFrame:
    return dedup.consolidated(pairs(t, 0.35), t.mem("importance"))


#: Matches of new rows (rated ones) with held rows and with new rows before them; then row by row, a row falls to one that is inserted.
_INSERT = """WITH RECURSIVE c AS (SELECT id, substr(content, 1, 100) AS head, embedding::DOUBLE[] AS v, id IN (SELECT doc_id FROM labels) AS fresh FROM mem WHERE embedding IS NOT NULL AND content <> ''),
p AS (SELECT n.id, h.id AS other, h.fresh FROM c n JOIN c h ON n.fresh AND n.id <> h.id AND (NOT h.fresh OR h.id < n.id) AND (contains(n.head, h.head) OR contains(h.head, n.head))
  AND round(1 - list_dot_product(n.v, h.v) / (sqrt(list_dot_product(n.v, n.v)) * sqrt(list_dot_product(h.v, h.v))), 6) < 1.15),
f AS (SELECT DISTINCT id FROM p WHERE NOT fresh),
r AS (SELECT id, list(other) AS others, row_number() OVER (ORDER BY id) AS k FROM p WHERE fresh AND id NOT IN (SELECT id FROM f) AND other NOT IN (SELECT id FROM f) GROUP BY id),
s AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
  SELECT r.k, CASE WHEN len(list_filter(others, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, r.id::BIGINT) ELSE gone END FROM s JOIN r ON r.k = s.k + 1)
SELECT id FROM f UNION SELECT unnest(gone) FROM (SELECT gone FROM s ORDER BY k DESC LIMIT 1)"""


@query(_INSERT, "mem")
def dedup_insert(t: Tables) -> DataFrame:
    """Rated memories as the insert batch, the others as the store; a wide distance, as the tables' vectors don't follow their texts."""
    heads = t.base("documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 100).alias("content"))  # cut before texts are joined
    m = stored(heads.join(t.base("embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding"), "id"), "heads")  # texts are read once
    rated = t.base("labels").select(F.col("doc_id").alias("id"))
    return dedup.insert_duplicates(m.join(rated, "id", "left_semi"), m.join(rated, "id", "left_anti"), distance=1.15)


@query("SELECT id, importance, CASE WHEN r <= 100 THEN 'keep_recent' WHEN importance < 0.3 THEN 'delete' ELSE 'keep' END AS action FROM (SELECT id, importance, CASE WHEN ts IS NULL THEN 1000000 ELSE row_number() OVER (ORDER BY ts DESC NULLS LAST, id) END AS r FROM mem)", "mem")
def retention_cleanup(t: Tables) -> DataFrame:
    return dedup.retention(t.mem("ts", "importance")).select("id", "importance", "action")


@query("SELECT id, CASE WHEN quality - 0.5e0 * toxic BETWEEN 0 AND 1 THEN quality - 0.5e0 * toxic ELSE importance END AS importance FROM mem LEFT JOIN labels ON doc_id = id", "mem")
def upd_importance(t: Tables) -> DataFrame:
    """Ratings as a batch of changes; values out of range change nothing."""
    m = t.mem("importance").select("id", "importance")
    new = t.base("labels").select(F.col("doc_id").alias("id"), dedup.valid_importance(F.expr("quality - 0.5D * toxic")).alias("importance"))
    return dedup.patched(m, new)


@query("SELECT id, summary FROM mem WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "mem")
def del_by_id(t: Tables) -> DataFrame:
    return dedup.without(t.mem().select("id", "summary"), t.base("labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "id")


@query(r"SELECT md5(session_id || ':' || turn) AS id, session_id, content, substr(content, 1, 150) AS summary, 0.5e0 AS importance, 'conversation' AS memory_type, 'chat' AS source, ts FROM msg WHERE length(regexp_replace(regexp_replace(content, '^\s+', ''), '\s+$', '')) >= 10", "msg")
def build_memories(t: Tables) -> DataFrame:
    """Messages to rows of the memory table: deterministic ids, defaults, summaries."""
    m = t.msg().where(F.length(fn.stripped("content")) >= 10)
    return m.select(F.md5(F.concat_ws(":", "session_id", "turn")).alias("id"), "session_id", "content", F.substring("content", 1, 150).alias("summary"), F.lit(0.5).alias("importance"), F.lit("conversation").alias("memory_type"), F.lit("chat").alias("source"), "ts")


@query(r"SELECT role, count(*) AS imported FROM msg WHERE role IN ('user', 'assistant') AND length(regexp_replace(regexp_replace(content, '^\s+', ''), '\s+$', '')) >= 10 AND NOT regexp_matches(content, '^\s*(好的?|明白|收到|可以|没问题|谢谢|嗯|是|对|行|ok)[，。！]?\s*$', 'i') GROUP BY role", "msg")
def imp_messages(t: Tables) -> DataFrame:
    return messages.imported(t.msg()).groupBy("role").agg(F.count("*").alias("imported"))


@query("SELECT session_id, n AS messages, CASE WHEN length(f) > 50 THEN substr(f, 1, 50) || '...' ELSE f END AS title FROM (SELECT session_id, count(*) AS n, min_by(content, turn) FILTER (role = 'user') AS f FROM msg GROUP BY session_id)", "msg")
def msg_session_title(t: Tables) -> DataFrame:
    return messages.titles(t.msg())


@query("SELECT * FROM (SELECT session_id, block, string_agg(role || ': ' || substr(content, 1, 500), chr(10) ORDER BY turn) AS text, count(*) AS messages FROM (SELECT *, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS block FROM msg WHERE role IN ('user', 'assistant')) GROUP BY session_id, block) WHERE length(text) >= 30", "msg")
def msg_blocks(t: Tables) -> DataFrame:
    return messages.blocks(t.msg().where("role IN ('user', 'assistant')"))


@query("SELECT role, substr(md5(content), 1, 16) AS hash, min(turn) AS turn, count(*) AS copies FROM msg GROUP BY ALL", "msg")
def msg_batch_dedup(t: Tables) -> DataFrame:
    return messages.batch_unique(t.msg(), "role")


@query("SELECT session_id, role, substr(content, 1, 100) AS head, min(turn) AS turn FROM msg GROUP BY ALL", "msg")
def msg_dedup_session(t: Tables) -> DataFrame:
    return messages.session_unique(t.msg())


@query("SELECT count(*) AS n FROM mem", "mem")
def agg_count(t: Tables) -> DataFrame:
    return t.mem().agg(F.count("*").alias("n"))


@query("SELECT agent_id, count(*) AS memories, count(DISTINCT memory_type) AS types, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(importance), 6) AS mean_importance FROM mem GROUP BY agent_id", "mem")
def agg_agent_stats(t: Tables) -> DataFrame:
    return t.mem("ts", "importance").groupBy("agent_id").agg(F.count("*").alias("memories"), F.count_distinct("memory_type").alias("types"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg("importance"), 6).alias("mean_importance"))


@query("SELECT role, count(DISTINCT session_id) AS sessions, max(ts) AS updated_at FROM msg GROUP BY role", "msg")
def agg_sessions(t: Tables) -> DataFrame:
    return t.msg().groupBy("role").agg(F.count_distinct("session_id").alias("sessions"), F.max("ts").alias("updated_at"))
