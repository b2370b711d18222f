"""Scans, filters, vector, lexical and hybrid retrieval, ranking."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import decay
from memloom.operators import filters, fusion, lexical, vector
from memloom.plans.registry import query
from memloom.plans.views import REF_TIME, TERMS, Tables

NOW = dt.datetime(2024, 1, 31)
VEC = ("mem", "qvec", "dist")
LEX = ("mem", "toks", "tf", "st", "bm25")
T = f"TIMESTAMP '{REF_TIME}'"


def ref():
    return F.lit(REF_TIME).cast("timestamp")


@query("SELECT id, summary, importance, agent_id, ts FROM mem ORDER BY id LIMIT 100", "mem")
def scan_memories(t: Tables) -> DataFrame:
    """Projection over a prefix in id order: the limit is taken before the joins."""
    first = t.base("documents").select("doc_id").orderBy("doc_id").limit(100)
    return t.mem("ts", "importance").join(F.broadcast(first), F.col("id") == F.col("doc_id")).select("id", "summary", "importance", "agent_id", "ts")


@query("SELECT id, summary FROM mem ORDER BY id LIMIT 20 OFFSET 40", "mem")
def scan_offset(t: Tables) -> DataFrame:
    return t.mem().select("id", "summary").orderBy("id").offset(40).limit(20)


@query("SELECT source, relation, target, confidence FROM kg", "kg")
def scan_kg(t: Tables) -> DataFrame:
    return t.kg()


@query("SELECT id, content, agent_id, memory_type, importance FROM mem WHERE id = 17", "mem")
def point_lookup(t: Tables) -> DataFrame:
    return t.mem("importance").where("id = 17").select("id", "content", "agent_id", "memory_type", "importance")


@query("SELECT id, ts FROM mem WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:05:00' AND TIMESTAMP '2024-01-05 12:00:00'", "mem")
def fil_time_range(t: Tables) -> DataFrame:
    lo, hi = dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 5, 12)
    return filters.within(t.mem("ts"), lo, hi).select("id", "ts")


@query("SELECT id, importance FROM mem WHERE importance >= 0.7 ORDER BY importance DESC, id LIMIT 50", "mem")
def fil_importance(t: Tables) -> DataFrame:
    return vector.top_k(t.mem("importance").select("id", "importance").where("importance >= 0.7"), 50, F.desc("importance"))


@query("SELECT id, summary FROM mem WHERE agent_id = 'src3'", "mem")
def fil_agent(t: Tables) -> DataFrame:
    return t.mem().where("agent_id = 'src3'").select("id", "summary")


TREE = {"operator": "And", "operands": [{"operator": "Or", "operands": [{"operator": "Equal", "path": ["memory_type"], "valueString": "de"}, {"operator": "Equal", "path": ["memory_type"], "valueString": "fr"}]}, {"operator": "Equal", "path": ["importance"], "valueNumber": 0.5}, {"operator": "Near", "path": ["x"], "valueString": "y"}]}


@query("SELECT id, memory_type FROM mem WHERE memory_type IN ('de', 'fr') AND importance = 0.5 ORDER BY id LIMIT 40", "mem")
def fil_tree(t: Tables) -> DataFrame:
    return filters.filtered(t.mem("importance"), TREE, 40).select("id", "memory_type")


def near(t: Tables, *need: str) -> DataFrame:
    """Memories with their distance from the query vector."""
    return vector.with_distance(t.vectors(*need), t.query_vector())


@query("SELECT id, distance FROM dist ORDER BY distance, id LIMIT 10", *VEC)
def ret_vector_topk(t: Tables) -> DataFrame:
    return vector.top_k(near(t).select("id", "distance"), 10, "distance")


@query("SELECT id, distance FROM dist WHERE memory_type = 'en' ORDER BY distance, id LIMIT 10", *VEC)
def ret_vector_filtered(t: Tables) -> DataFrame:
    """The filter runs before the vectors are compared."""
    kept = filters.filtered(t.vectors(), {"operator": "Equal", "path": ["memory_type"], "valueString": "en"})
    return vector.top_k(vector.with_distance(kept, t.query_vector()).select("id", "distance"), 10, "distance")


_SEARCH = """c AS (SELECT * FROM dist ORDER BY distance, id LIMIT {n3}),
s AS (SELECT id, distance, importance, round(importance * 0.4e0 + CASE WHEN m > 0 THEN 1 - distance / m ELSE 1e0 END * 0.6e0, 6) AS score FROM c, (SELECT max(distance) AS m FROM c)),
r AS (SELECT * FROM s ORDER BY score DESC, id LIMIT {n})"""


@query("WITH " + _SEARCH.format(n3=30, n=10) + " SELECT id, distance, importance, score FROM r", *VEC)
def ret_search_memory(t: Tables) -> DataFrame:
    return fusion.composite(near(t, "importance").select("id", "distance", "importance"), 10)


@query("WITH " + _SEARCH.format(n3=30, n=10) + " SELECT id, distance, round(1 - distance, 6) AS score FROM r ORDER BY distance, id LIMIT 5", *VEC)
def ret_recall(t: Tables) -> DataFrame:
    """Twice the limit by composite score, then the nearest."""
    c = fusion.composite(near(t, "importance").select("id", "distance", "importance"), 10)
    return vector.top_k(c.select("id", "distance", F.round(1 - F.col("distance"), 6).alias("score")), 5, "distance")


def words(t: Tables) -> DataFrame:
    return lexical.bm25(t.mem(), "content", TERMS)


@query("SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 10", *LEX)
def ret_bm25(t: Tables) -> DataFrame:
    return vector.top_k(words(t), 10, F.desc("score"))


_HYBRID = """v AS (SELECT id, CASE WHEN hi > lo THEN 1 - (distance - lo) / (hi - lo) ELSE 1e0 END AS v FROM dist, (SELECT min(distance) AS lo, max(distance) AS hi FROM dist)),
b AS (SELECT id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1e0 END AS b FROM bm25, (SELECT min(score) AS lo, max(score) AS hi FROM bm25)),
h AS (SELECT id, round(0.5e0 * coalesce(v, 0) + 0.5e0 * coalesce(b, 0), 6) AS score FROM v FULL JOIN b USING (id) ORDER BY score DESC, id LIMIT {n})"""
BOTH = tuple(dict.fromkeys(VEC + LEX))


@query("WITH " + _HYBRID.format(n=10) + " SELECT id, score FROM h", *BOTH)
def ret_hybrid_alpha(t: Tables) -> DataFrame:
    return fusion.relative_score(near(t), words(t), 0.5, 10)


def with_weight(t: Tables, hits: DataFrame) -> DataFrame:
    """Hits with their time weight; at most a page of rows, broadcast to the scan that has the times."""
    return t.mem("ts", "importance").join(F.broadcast(hits), "id").select("id", "score", F.round(decay.weight(F.col("ts"), F.col("importance"), ref()), 6).alias("time_weight"))


_WEIGHT = f"round(CASE WHEN ts IS NULL THEN importance ELSE least(importance * CASE WHEN greatest((epoch_us({T}) - epoch_us(ts)) / 86400e6, 0e0) < 1 THEN 1.2e0 ELSE power(0.9e0, greatest((epoch_us({T}) - epoch_us(ts)) / 86400e6, 0e0) / 7) END, 1e0) END, 6)"


@query(f"WITH h AS (SELECT id, round(1 - distance, 6) AS score FROM dist ORDER BY distance, id LIMIT 10) SELECT id, score, {_WEIGHT} AS time_weight, 'vector' AS search_mode FROM h JOIN mem USING (id)", *VEC)
def ret_mode_vector(t: Tables) -> DataFrame:
    h = vector.top_k(near(t), 10, "distance").select("id", F.round(1 - F.col("distance"), 6).alias("score"))
    return with_weight(t, h).withColumn("search_mode", F.lit("vector"))


@query(f"WITH h AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 10) SELECT id, score, {_WEIGHT} AS time_weight, 'bm25' AS search_mode FROM h JOIN mem USING (id)", *LEX)
def ret_mode_bm25(t: Tables) -> DataFrame:
    return with_weight(t, ret_bm25(t)).withColumn("search_mode", F.lit("bm25"))


@query("WITH " + _HYBRID.format(n=10) + f" SELECT id, score, {_WEIGHT} AS time_weight, 'hybrid' AS search_mode FROM h JOIN mem USING (id)", *BOTH)
def ret_mode_hybrid(t: Tables) -> DataFrame:
    return with_weight(t, ret_hybrid_alpha(t)).withColumn("search_mode", F.lit("hybrid"))


_DAYS = f"((epoch_us({T}) - epoch_us(ts)) / 86400e6)"
_RTIME = f"CASE WHEN ts IS NULL THEN 0.5e0 ELSE greatest(exp(-floor({_DAYS}) / 7), 0.1e0) END"
_RECALL = """v AS (SELECT id, 1 - distance AS v FROM dist ORDER BY distance, id LIMIT 20),
b0 AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 20),
b AS (SELECT id, CASE WHEN m > 0 THEN least(score / m, 1e0) ELSE 0e0 END AS b FROM b0, (SELECT max(score) AS m FROM b0))
SELECT id, round(0.3e0 * coalesce(b, 0.5e0 * (SELECT coalesce(avg(b), 0) FROM b)) + 0.6e0 * coalesce(v, 0) + 0.1e0 * {time}, 6) AS score
FROM v FULL JOIN b USING (id) LEFT JOIN (SELECT id, ts FROM mem) USING (id) ORDER BY score DESC, id LIMIT 10"""


@query("WITH " + _RECALL.format(time=_RTIME), *BOTH)
def ret_hybrid_recall(t: Tables) -> DataFrame:
    return fusion.recall(near(t), words(t), t.mem("ts").select("id", "ts"), ref(), 10)


@query("WITH " + _RECALL.format(time="0.5e0"), *BOTH)
def ret_hybrid_recall_compat(t: Tables) -> DataFrame:
    return fusion.recall(near(t), words(t), t.mem("ts").select("id", "ts"), ref(), 10, compat=True)


def lists(t: Tables) -> dict[str, DataFrame]:
    """Two lists of twenty, ranked."""
    return {"vector": fusion.ranked(vector.top_k(near(t), 20, "distance"), F.col("distance")), "bm25": fusion.ranked(vector.top_k(words(t), 20, F.desc("score")), F.desc("score"))}


_RRF = """l AS (SELECT id, 'vector' AS k, row_number() OVER (ORDER BY distance, id) AS rank FROM dist QUALIFY rank <= 20
UNION ALL SELECT id, 'bm25', row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25 QUALIFY rank <= 20),
f AS (SELECT id, round(sum(1e0 / (60 + rank)), 6) AS score, max(rank) FILTER (k = 'vector') AS vector_rank, max(rank) FILTER (k = 'bm25') AS bm25_rank FROM l GROUP BY id)"""


@query("WITH " + _RRF + " SELECT id, score, vector_rank, bm25_rank FROM f", *BOTH)
def ret_rrf(t: Tables) -> DataFrame:
    return fusion.reciprocal_rank(lists(t))


_RERANK = f"round(similarity * 0.7e0 + importance * 0.3e0 + 0.2e0 * CASE WHEN ts IS NULL THEN 0.5e0 ELSE greatest(least(exp(-0.1e0 * floor({_DAYS}) / 30), 1e0), 0e0) END, 6)"


def similar(t: Tables, *need: str) -> DataFrame:
    return near(t, *need).withColumn("similarity", F.round(1 - F.col("distance"), 6))


@query("WITH " + _RRF + f" SELECT id, {_RERANK} AS score FROM (SELECT d.id, round(1 - distance, 6) AS similarity, importance, ts, content FROM dist d JOIN (SELECT id FROM f ORDER BY score DESC, id LIMIT 20) USING (id)) WHERE content <> '' ORDER BY score DESC, id LIMIT 10", *BOTH)
def ret_rerank(t: Tables) -> DataFrame:
    """Twenty fused candidates, reranked by what the store already has; no text is embedded again."""
    c = vector.top_k(fusion.reciprocal_rank(lists(t)), 20, F.desc("score")).select("id")
    return fusion.rerank(similar(t, "ts", "importance").join(F.broadcast(c), "id"), ref(), 10).select("id", "score")


@query(f"SELECT id, {_RERANK} AS score FROM (SELECT *, round(1 - distance, 6) AS similarity FROM dist WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-10 23:59:59.999999') WHERE content <> '' ORDER BY score DESC, id LIMIT 10", *VEC)
def ret_time_rerank(t: Tables) -> DataFrame:
    lo, hi = filters.named_range(None, NOW, dt.date(2024, 1, 1), dt.date(2024, 1, 10))
    return fusion.rerank(filters.within(similar(t, "ts", "importance"), lo, hi), ref(), 10).select("id", "score")


@query("WITH " + _HYBRID.replace(" ORDER BY score DESC, id LIMIT {n}", "") + f" SELECT id, score, {_WEIGHT} AS time_weight FROM h JOIN mem USING (id) WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' ORDER BY score DESC, id LIMIT 10", *BOTH)
def ret_time_search(t: Tables) -> DataFrame:
    """The best rows of a time range by their hybrid score; scores are scaled over all rows, and nothing is cut before the range."""
    scored = fusion.relative_score(near(t), words(t), 0.5, None)
    ranged = filters.within(t.mem("ts").select("id", "ts"), NOW.replace(day=1), NOW.replace(day=15))
    hits = vector.top_k(scored.join(ranged.select("id"), "id", "left_semi"), 10, F.desc("score"))
    return vector.top_k(with_weight(t, hits), 10, F.desc("score"))


@query("SELECT id, distance FROM dist WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00' ORDER BY distance, id LIMIT 5", *VEC)
def ret_smart_query(t: Tables) -> DataFrame:
    """A question whose words name a range: the range is filtered before the nearest are taken."""
    lo, hi = filters.hinted_range("本月 the notes", NOW)
    return vector.top_k(filters.within(near(t, "ts"), lo, hi).select("id", "distance"), 5, "distance")


@query(f"SELECT id, {_WEIGHT} AS weight FROM mem", "mem")
def rnk_time_decay(t: Tables) -> DataFrame:
    return t.mem("ts", "importance").select("id", F.round(decay.weight(F.col("ts"), F.col("importance"), ref()), 6).alias("weight"))


@query(f"SELECT id, round({_RTIME}, 6) AS time_score FROM mem", "mem")
def rnk_recall_time(t: Tables) -> DataFrame:
    return t.mem("ts").select("id", F.round(decay.recall_time(F.col("ts"), ref()), 6).alias("time_score"))


@query(f"SELECT id, {_RERANK} AS score FROM (SELECT *, round(1 - distance, 6) AS similarity FROM dist) WHERE content <> ''", *VEC)
def rnk_rerank(t: Tables) -> DataFrame:
    return fusion.rerank(similar(t, "ts", "importance"), ref(), 1 << 30).select("id", "score")


_RANGES = "(VALUES ('today', TIMESTAMP '2024-01-30 00:00:00', TIMESTAMP '2024-01-30 18:00:00'), ('yesterday', TIMESTAMP '2024-01-29 00:00:00', TIMESTAMP '2024-01-30 00:00:00'), ('week', TIMESTAMP '2024-01-23 18:00:00', TIMESTAMP '2024-01-30 18:00:00'), ('lastweek', TIMESTAMP '2024-01-16 18:00:00', TIMESTAMP '2024-01-23 18:00:00'), ('month', TIMESTAMP '2023-12-31 18:00:00', TIMESTAMP '2024-01-30 18:00:00')) r(name, lo, hi)"


@query(f"SELECT name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events, {_RANGES} WHERE ts BETWEEN lo AND hi GROUP BY name")
def tim_named_range(t: Tables) -> DataFrame:
    """All named ranges in one pass: a row goes to each range that holds it, five constants."""
    now = dt.datetime(2024, 1, 30, 18)
    form = lambda x: F.lit(x.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    marks = [F.when(F.col("ts").between(*map(form, filters.named_range(n, now))), n) for n in ("today", "yesterday", "week", "lastweek", "month")]
    e = t.base("events").select("ts", F.explode(F.array_compact(F.array(*marks))).alias("name"))
    return e.groupBy("name").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
