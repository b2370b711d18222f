"""Knowledge-graph plans over the two triple views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import decay
from memloom.functions import entities as ent
from memloom.operators import graph, vector
from memloom.plans.registry import query
from memloom.plans.views import Tables

OPPOSITES = {"click": "error", "error": "click", "view": "purchase"}


@query("SELECT relation <> '' AND relation <> 'is_entity' AS is_relation, count(*) AS n FROM kg GROUP BY 1", "kg")
def kg_split(t: Tables) -> DataFrame:
    return t.kg().groupBy(((F.col("relation") != "") & (F.col("relation") != "is_entity")).alias("is_relation")).agg(F.count("*").alias("n"))


@query("SELECT source, relation, target FROM kg WHERE source = 'NATION_3' OR target = 'NATION_3'", "kg")
def kg_by_entity(t: Tables) -> DataFrame:
    return t.kg().where("source = 'NATION_3' OR target = 'NATION_3'").select("source", "relation", "target")


@query("SELECT DISTINCT source, relation, target FROM kg_ev", "kg_ev")
def kg_distinct(t: Tables) -> DataFrame:
    return t.kg_ev().select("source", "relation", "target").distinct()


@query("SELECT source, target, arg_max(relation, (confidence, relation)) AS relation, max(confidence) AS confidence FROM kg_ev GROUP BY source, target", "kg_ev")
def kg_last_edge(t: Tables) -> DataFrame:
    """One edge for each ordered pair, the strongest as the last."""
    return t.kg_ev().groupBy("source", "target").agg(F.max_by("relation", F.struct("confidence", "relation")).alias("relation"), F.max("confidence").alias("confidence"))


@query("SELECT k.source, s.n_nationkey AS source_key, k.relation, k.target, g.r_regionkey AS target_key FROM kg k LEFT JOIN nation s ON s.n_name = k.source LEFT JOIN region g ON g.r_name = k.target", "kg")
def kg_edges_named(t: Tables) -> DataFrame:
    n = t.base("nation").select(F.col("n_name").alias("source"), F.col("n_nationkey").alias("source_key"))
    r = t.base("region").select(F.col("r_name").alias("target"), F.col("r_regionkey").alias("target_key"))
    return t.kg().join(n, "source", "left").join(r, "target", "left").select("source", "source_key", "relation", "target", "target_key")


@query("SELECT count(DISTINCT name) AS n FROM (SELECT source AS name FROM kg_ev UNION ALL SELECT target FROM kg_ev)", "kg_ev")
def kg_count_entities(t: Tables) -> DataFrame:
    return graph.entities(t.kg_ev()).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (relation <> '') AS n FROM kg_ev", "kg_ev")
def kg_count_relations(t: Tables) -> DataFrame:
    return t.kg_ev().agg(F.count_if(F.col("relation") != "").alias("n"))


@query("SELECT relation, count(*) AS n, count(DISTINCT target) AS targets FROM kg_ev GROUP BY relation", "kg_ev")
def kg_type_dist(t: Tables) -> DataFrame:
    return t.kg_ev().groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


_ENDS = "(SELECT source AS name FROM {0} UNION ALL SELECT target FROM {0})"


@query(f"SELECT name, count(*) AS degree FROM {_ENDS.format('kg_ev')} GROUP BY name ORDER BY degree DESC, name LIMIT 10", "kg_ev")
def kg_degree(t: Tables) -> DataFrame:
    return vector.top_k(graph.degree(t.kg_ev()), 10, F.desc("degree"), tie="name")


@query("SELECT source AS name, count(*) AS mentions FROM kg_ev GROUP BY source", "kg_ev")
def kg_entity_mentions(t: Tables) -> DataFrame:
    return t.kg_ev().groupBy(F.col("source").alias("name")).agg(F.count("*").alias("mentions"))


@query("SELECT target AS name, relation, 'out' AS direction, confidence FROM kg WHERE source = 'NATION_3' UNION ALL SELECT source, relation, 'in', confidence FROM kg WHERE target = 'NATION_3'", "kg")
def kg_neighbors(t: Tables) -> DataFrame:
    return graph.neighbors(t.kg(), "NATION_3")


@query("SELECT source, relation, target FROM kg WHERE source IN ('NATION_3', 'EUROPE') OR target IN ('NATION_3', 'EUROPE')", "kg")
def kg_touching(t: Tables) -> DataFrame:
    return t.kg().where("source IN ('NATION_3', 'EUROPE') OR target IN ('NATION_3', 'EUROPE')").select("source", "relation", "target")


_EDGES = "e AS (SELECT source AS u, target AS v FROM kg UNION SELECT target, source FROM kg)"


@query(f"WITH RECURSIVE {_EDGES}, h AS (SELECT 'NATION_3' AS name, 0 AS d UNION SELECT v, d + 1 FROM h JOIN e ON u = name WHERE d < 2) SELECT name, min(d)::INT AS distance FROM h WHERE name <> 'NATION_3' GROUP BY name", "kg")
def kg_khop(t: Tables) -> DataFrame:
    return graph.k_hop(t.kg(), "NATION_3", 2)


@query(
    f"WITH RECURSIVE {_EDGES}, p AS (SELECT ['NATION_18'] AS path UNION ALL SELECT list_append(path, v) FROM p JOIN e ON u = path[-1] WHERE len(path) <= 4 AND path[-1] <> 'NATION_3' AND NOT list_contains(path, v)), f AS (SELECT (len(path) - 1)::INT AS hops, array_to_string(path, ' > ') AS path FROM p WHERE path[-1] = 'NATION_3') SELECT hops, path FROM f WHERE hops = (SELECT min(hops) FROM f)",
    "kg",
)
def kg_shortest_path(t: Tables) -> DataFrame:
    return graph.shortest_paths(t.kg(), "NATION_18", "NATION_3", 4).select("hops", F.array_join("path", " > ").alias("path"))


_STRONG = """e0 AS (SELECT source AS u, target AS v FROM kg_ev WHERE confidence >= 0.35), e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0),
h AS (SELECT (SELECT min(u) FROM e0) AS name, 0 AS d UNION SELECT v, d + 1 FROM h JOIN e ON u = name WHERE d < 10),
m AS (SELECT name, min(d)::INT AS distance FROM h WHERE name IS NOT NULL GROUP BY name)"""


def strong(t: Tables) -> tuple[DataFrame, str | None]:
    """The sparse graph of strong edges between users and items, and its first user."""
    e = t.kg_ev().where("confidence >= 0.35")
    return e, e.agg(F.min("source")).first()[0]


@query(f"WITH RECURSIVE {_STRONG} SELECT name, distance FROM m WHERE distance > 0", "kg_ev")
def kg_khop_deep(t: Tables) -> DataFrame:
    """What ten strong edges or fewer reach from a user."""
    e, start = strong(t)
    return graph.k_hop(e, start or "", 10)


@query(
    f"WITH RECURSIVE {_STRONG}, far AS (SELECT name, distance FROM m ORDER BY distance DESC, name LIMIT 1), p AS (SELECT [name] AS path, distance AS d FROM m WHERE distance = 0 UNION ALL SELECT list_append(path, v), d + 1 FROM p JOIN e ON u = path[-1] JOIN m ON m.name = v AND m.distance = d + 1) SELECT distance AS hops, array_to_string(path, ' > ') AS path FROM p JOIN far ON path[-1] = far.name AND d = far.distance WHERE d > 0",
    "kg_ev",
)
def kg_shortest_deep(t: Tables) -> DataFrame:
    """Every shortest path from a user to the farthest node that ten strong edges reach."""
    e, start = strong(t)
    far = graph.k_hop(e, start or "", 10).orderBy(F.desc("distance"), "name").first()
    return graph.shortest_paths(e, start or "", far.name if far else "", 10).select("hops", F.array_join("path", " > ").alias("path"))


_INFER = "SELECT a.source, a.relation, b.target, round(max(least(a.confidence, b.confidence) * 0.8e0), 6) AS confidence FROM {0} a JOIN {0} b ON a.target = b.source AND a.relation = b.relation WHERE a.source <> b.target AND NOT EXISTS (SELECT 1 FROM {0} x WHERE x.source = a.source AND x.target = b.target) GROUP BY ALL"
_PLACES = "g AS (SELECT source, 'in' AS relation, target, confidence FROM kg)"


@query(f"WITH {_PLACES} {_INFER.format('g')}", "kg")
def kg_infer(t: Tables) -> DataFrame:
    """Both relations as one transitive `in`: customers and suppliers come to lie in regions."""
    g = t.kg().withColumn("relation", F.lit("in"))
    return graph.infer(g, ["in"])


_OPP = "(VALUES ('click', 'error'), ('error', 'click'), ('view', 'purchase')) o(r1, r2)"
_CONTRA = f"SELECT a.source, a.target, o.r1, o.r2, a.confidence AS c1, b.confidence AS c2 FROM kg_ev a JOIN {_OPP} ON a.relation = o.r1 JOIN kg_ev b ON b.source = a.source AND b.target = a.target AND b.relation = o.r2"


@query(_CONTRA, "kg_ev")
def kg_contradictions(t: Tables) -> DataFrame:
    return graph.contradictions(t.kg_ev(), OPPOSITES)


@query(f"SELECT source, relation, target, confidence FROM kg_ev k WHERE NOT EXISTS (SELECT 1 FROM ({_CONTRA}) c WHERE c.source = k.source AND c.target = k.target AND c.r1 = k.relation AND (c1 < c2 OR (c1 = c2 AND r1 > r2)))", "kg_ev")
def kg_resolve_contradiction(t: Tables) -> DataFrame:
    return graph.resolved(t.kg_ev(), OPPOSITES)


@query("SELECT source, relation, target, max(confidence) AS confidence FROM (SELECT CASE WHEN source IN ('NATION_3', 'NATION_18') THEN 'NATION_3-18' ELSE source END AS source, relation, CASE WHEN target IN ('NATION_3', 'NATION_18') THEN 'NATION_3-18' ELSE target END AS target, confidence FROM kg) WHERE source <> target GROUP BY ALL", "kg")
def kg_merge(t: Tables) -> DataFrame:
    return graph.merged(t.kg(), ["NATION_3", "NATION_18"], "NATION_3-18")


@query("SELECT DISTINCT n AS name, coalesce(c, n) AS canonical, EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = lower(coalesce(c, n))) AS is_existing FROM (SELECT DISTINCT upper(lang) AS n FROM documents) LEFT JOIN (VALUES ('de', 'Nation_3'), ('FR', 'Nation_18'), ('en', 'Nowhere')) a(k, c) ON lower(k) = lower(n)")
def kg_resolve(t: Tables) -> DataFrame:
    mentions = t.base("documents").select(F.upper("lang").alias("name")).distinct()
    aliases = t.spark.createDataFrame([("de", "Nation_3"), ("FR", "Nation_18"), ("en", "Nowhere")], "alias string, canonical string")
    return graph.resolved_names(mentions, aliases, t.base("nation").select(F.col("n_name").alias("name")))


_SEEN = "SELECT a.relation AS a, b.relation AS b, count(*) AS n FROM (SELECT DISTINCT source, relation FROM kg_ev) a JOIN (SELECT DISTINCT source, relation FROM kg_ev) b ON a.source = b.source AND a.relation < b.relation GROUP BY ALL"


@query(_SEEN, "kg_ev")
def kg_cooccur(t: Tables) -> DataFrame:
    """Event types that one user shows: pairs within a small set of types."""
    return graph.co_occurrence(t.kg_ev(), "source", "relation")


@query(f"SELECT a AS source, '相关' AS relation, b AS target, round(least(0.1e0 * n, 0.9e0), 6) AS confidence FROM ({_SEEN}) WHERE n >= 3 AND NOT (a = 'click' AND b = 'error')", "kg_ev")
def kg_hebbian(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("error", "click", 0.5)], "source string, target string, confidence double")
    return graph.hebbian(graph.co_occurrence(t.kg_ev(), "source", "relation"), known)


@query("SELECT source, relation, target, round(least(confidence + coalesce(n, 0) * 0.05e0, 1e0), 6) AS confidence FROM kg LEFT JOIN (SELECT n_name AS a, r_name AS b, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) ON least(source, target) = least(a, b) AND greatest(source, target) = greatest(a, b)", "kg")
def kg_update_confidence(t: Tables) -> DataFrame:
    """Nations and regions seen together once for each supplier."""
    s = t.base("supplier").join(t.base("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t.base("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = s.groupBy(F.least("n_name", "r_name").alias("a"), F.greatest("n_name", "r_name").alias("b")).agg(F.count("*").alias("n"))
    return graph.boosted(t.kg(), pairs)


@query("SELECT event_id, round(greatest(least(value / 500, 1e0) * power(0.95e0, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 86400e6 / 30), 0.1e0), 6) AS confidence FROM events")
def kg_conf_decay(t: Tables) -> DataFrame:
    days = decay.days_between(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return t.base("events").select("event_id", F.round(decay.confidence(F.least(F.col("value") / 500, F.lit(1.0)), days), 6).alias("confidence"))


@query("SELECT source, relation, target, confidence FROM kg_ev WHERE confidence >= 0.3", "kg_ev")
def kg_cleanup_conf(t: Tables) -> DataFrame:
    return t.kg_ev().where("confidence >= 0.3")


@query("SELECT count(*) AS n, count(*) FILTER (confidence >= 0.8) AS sure, count(*) FILTER (confidence < 0.3) AS doubtful, round(avg(confidence), 6) AS mean_confidence FROM kg_ev", "kg_ev")
def kg_quality(t: Tables) -> DataFrame:
    return t.kg_ev().agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("sure"), F.count_if(F.col("confidence") < 0.3).alias("doubtful"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("SELECT 'u' || user_id AS source, event_type AS relation, 'k' || (props->>'$.k') AS target, max(round(least(value / 500, 1e0), 6)) AS confidence, count(*) AS seen FROM events GROUP BY ALL")
def kg_merge_results(t: Tables) -> DataFrame:
    e = t.base("events").select(F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_type").alias("relation"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("target"), F.round(F.least(F.col("value") / 500, F.lit(1.0)), 6).alias("confidence"))
    return graph.best_of(e)


@query(f"SELECT name, least(10 + 3 * count(*), 50) AS size FROM {_ENDS.format('kg')} GROUP BY name", "kg")
def kg_graph_nodes(t: Tables) -> DataFrame:
    return graph.degree(t.kg()).select("name", F.least(10 + 3 * F.col("degree"), F.lit(50)).alias("size"))


@query("SELECT DISTINCT source, relation, target FROM kg", "kg")
def kg_graph_links(t: Tables) -> DataFrame:
    return t.kg().select("source", "relation", "target").distinct()


@query("SELECT source, relation, target FROM kg WHERE source <> 'NATION_3' AND target <> 'NATION_3'", "kg")
def kg_delete_entity(t: Tables) -> DataFrame:
    return t.kg().where("source <> 'NATION_3' AND target <> 'NATION_3'").select("source", "relation", "target")


@query("SELECT source, relation, target FROM kg WHERE NOT (source = 'NATION_3' AND relation = 'PartOf' AND target = 'EUROPE')", "kg")
def kg_delete_relation(t: Tables) -> DataFrame:
    gone = t.spark.createDataFrame([("NATION_3", "PartOf", "EUROPE")], "source string, relation string, target string")
    return t.kg().join(gone, ["source", "relation", "target"], "left_anti").select("source", "relation", "target")


@query("SELECT source, CASE WHEN relation IN ('PartOf', 'IsA', 'HasA') THEN relation ELSE '相关' END AS relation, target, substr(source || ' ' || relation || ' ' || target, 1, 200) AS evidence FROM kg", "kg")
def kg_type_normalize(t: Tables) -> DataFrame:
    known = F.col("relation").isin("PartOf", "IsA", "HasA")
    return t.kg().select("source", F.when(known, F.col("relation")).otherwise("相关").alias("relation"), "target", F.substring(F.concat_ws(" ", "source", "relation", "target"), 1, 200).alias("evidence"))


_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(p_name, '{p}', 'i') THEN '{k}'" for k, patterns in ent.TYPES for p in patterns) + " ELSE '概念' END"


@query(f"SELECT p_name AS name, {_TYPE} AS type, length(p_name) >= 2 AND NOT regexp_matches(p_name, '^[0-9]+$') AS valid FROM part")
def kg_infer_type(t: Tables) -> DataFrame:
    return t.base("part").select(F.col("p_name").alias("name"), ent.infer_type("p_name").alias("type"), ent.valid_entity("p_name").alias("valid"))


@query("SELECT source, relation, target, round(1 - distance, 6) AS score FROM kg JOIN dist ON id = regexp_extract(source, '[0-9]+$')::BIGINT ORDER BY score DESC, source, relation, target LIMIT 10", "mem", "qvec", "dist", "kg")
def kg_search(t: Tables) -> DataFrame:
    """Nearest triples: a triple has the vector of the number in its source's name (the tables hold no vectors of triples)."""
    k = t.kg().withColumn("id", F.regexp_extract("source", "[0-9]+$", 0).cast("long"))
    near = vector.with_distance(k.join(t.vectors().select("id", "embedding"), "id"), t.query_vector())
    scored = near.select("source", "relation", "target", F.round(1 - F.col("distance"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "source", "relation", "target").limit(10)


@query("SELECT DISTINCT name FROM (SELECT source AS name FROM kg UNION ALL SELECT target FROM kg) WHERE contains(lower(name), 'tion_1') ORDER BY name LIMIT 20", "kg")
def kg_search_entities(t: Tables) -> DataFrame:
    return graph.entities(t.kg()).where(F.lower("name").contains("tion_1")).orderBy("name").limit(20)


@query("SELECT conv_id AS doc, a AS source, b AS target FROM (SELECT conv_id, string_agg(lower(text), ' ') AS x FROM conversations GROUP BY conv_id), (VALUES ('the', 'of'), ('elle', 'aux'), ('der', 'die')) p(a, b) WHERE contains(x, a) AND contains(x, b)")
def kg_verify(t: Tables) -> DataFrame:
    """Edges of which a conversation's turns hold both ends; a conversation is reduced to the names it holds, with a partial step."""
    names_in = ("the", "of", "elle", "aux", "der", "die")
    held = t.base("conversations").select(F.col("conv_id").alias("doc"), *(F.lower("text").contains(n).alias(n) for n in names_in)).groupBy("doc").agg(*(F.max(n).alias(n) for n in names_in))
    c = held.select("doc", F.concat_ws(" ", *(F.when(F.col(n), n) for n in names_in)).alias("text"))
    pairs = F.explode(F.expr("array(struct('the' AS source, 'of' AS target), struct('elle' AS source, 'aux' AS target), struct('der' AS source, 'die' AS target))")).alias("p")
    edges = c.select("doc", pairs).select("doc", "p.source", "p.target")
    names = c.select("doc", "text", F.explode(F.array(*map(F.lit, ("the", "of", "elle", "aux", "der", "die")))).alias("name")).withColumn("confidence", F.lit(0.5))
    return graph.verified(names, edges).select("doc", "source", "target")
