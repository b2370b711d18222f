"""Plans that change tables: inserts, clears, imports, fact merges, listings and kinds of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import builders, chunker, models, stores
from memloom.operators.buckets import BucketTable
from memloom.operators.shared import scratch
from memloom.plans import texts
from memloom.plans.knowledge import _WIN
from memloom.plans.registry import query
from memloom.plans.views import REF_TIME, Tables
from memloom.streaming import enrich


@query("SELECT md5(conv_id || ':' || turn) AS id, role, substr(coalesce(string_agg, ''), 1, 10000) AS raw_conversation, substr(coalesce(text, ''), 1, 500) AS context FROM (SELECT *, repeat(text, 30) AS string_agg FROM conversations)")
def mem_insert_raw(t: Tables) -> DataFrame:
    """Turns as memories of long raw conversations: raw text and context cut to what the store keeps."""
    c = t.base("conversations").select(F.md5(F.concat_ws(":", "conv_id", "turn")).alias("id"), "role", F.repeat("text", 30).alias("raw_conversation"), F.col("text").alias("context"))
    return stores.memory_rows(c)


@query("SELECT source, relation, target, CASE WHEN ts IS NULL THEN TIMESTAMP '2024-01-31 00:00:00' ELSE ts END AS ts, n FROM (SELECT 'u' || user_id AS source, event_type AS relation, 'k' || (props->>'$.k') AS target, min(CASE WHEN event_type <> 'error' THEN ts END) AS ts, 1::BIGINT AS n FROM events GROUP BY 1, 2, 3)")
def kg_insert(t: Tables) -> DataFrame:
    """Triples of the events put into an empty store twice: ids make the second time change nothing; a triple without a time gets the present one."""
    e = t.base("events").select(F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_type").alias("relation"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("target"), F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))
    rows = stores.triple_rows(e.groupBy("source", "relation", "target").agg(F.min("ts").alias("ts")), F.lit(REF_TIME).cast("timestamp"))
    once = stores.inserted(rows.where("false"), rows)
    return stores.inserted(once, rows).groupBy("source", "relation", "target").agg(F.min("ts").alias("ts"), F.count("*").alias("n"))


_MIXED = "mixed AS (SELECT * FROM (SELECT source, relation, target FROM kg UNION ALL SELECT DISTINCT source, CASE WHEN relation = 'PartOf' THEN 'is_a' ELSE '' END, 'thing' FROM kg))"


def mixed(t: Tables) -> DataFrame:
    """Relation rows, and an entity row for each source."""
    k = t.kg().select("source", "relation", "target")
    named = k.select("source", F.when(F.col("relation") == "PartOf", "is_a").otherwise("").alias("relation"), F.lit("thing").alias("target")).distinct()
    return k.unionByName(named)


@query(f"WITH {_MIXED} SELECT source, relation, target FROM mixed WHERE relation NOT IN ('', 'is_a', 'is_entity')", "kg")
def kg_clear_entities(t: Tables) -> DataFrame:
    return stores.cleared(mixed(t), entities=True)


@query(f"WITH {_MIXED} SELECT source, relation, target FROM mixed WHERE relation IN ('', 'is_a', 'is_entity')", "kg")
def kg_clear_relations(t: Tables) -> DataFrame:
    return stores.cleared(mixed(t), relations=True)


_NEW = "new AS (SELECT min(doc_id) + 10000000 AS id, text AS content FROM documents WHERE doc_id % 2 = 1 AND text <> '' GROUP BY text), held AS (SELECT doc_id AS id, text AS content FROM documents WHERE doc_id % 2 = 0)"


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The memories of even ids as the store, those of odd ids, under new ids, as an export."""
    d = t.base("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return d.where("id % 2 = 0"), d.where("id % 2 = 1").withColumn("id", F.col("id") + 10_000_000)


@query(f"WITH {_NEW} SELECT id, md5(content) AS hash FROM held UNION ALL SELECT id, md5(content) FROM new WHERE content NOT IN (SELECT content FROM held WHERE content IS NOT NULL)")
def agent_import_merge(t: Tables) -> DataFrame:
    return stores.imported(*halves(t)).select("id", F.md5("content").alias("hash"))


@query(f"WITH {_NEW} SELECT id, md5(content) AS hash FROM new")
def agent_import_overwrite(t: Tables) -> DataFrame:
    return stores.imported(*halves(t), mode="overwrite").select("id", F.md5("content").alias("hash"))


_FACTS = """f AS (SELECT DISTINCT user_id AS owner, event_type AS kind, 'the user likes item k' || (props->>'$.k') AS fact FROM events),
held AS (SELECT DISTINCT owner, fact FROM f WHERE kind = 'view'), new AS (SELECT DISTINCT owner, fact FROM f WHERE kind = 'purchase'),
told AS (SELECT owner, fact, CASE WHEN bool_or(kind = 'signup') THEN 'UPDATE' ELSE 'DELETE' END AS event FROM f WHERE kind IN ('signup', 'error') GROUP BY ALL)"""


@query(
    f"WITH {_FACTS} SELECT owner, CASE WHEN event = 'UPDATE' THEN fact || ' now' ELSE fact END AS fact, coalesce(event, 'NONE') AS event FROM held LEFT JOIN told USING (owner, fact) UNION ALL SELECT owner, fact, 'ADD' FROM new WHERE (owner, fact) NOT IN (SELECT owner, fact FROM held)"
)
def fact_merge(t: Tables) -> DataFrame:
    """Viewed items as held facts, purchases as new ones; sign-ups and errors stand for a model's decisions to update and to delete."""
    f = t.base("events").select(F.col("user_id").alias("owner"), "event_type", F.concat(F.lit("the user likes item k"), F.get_json_object("props", "$.k")).alias("fact"))
    told = f.where("event_type IN ('signup', 'error')").select("owner", "fact", F.when(F.col("event_type") == "signup", "UPDATE").otherwise("DELETE").alias("event"), F.concat("fact", F.lit(" now")).alias("text"))
    return models.merged_facts(f.where("event_type = 'view'").select("owner", "fact"), f.where("event_type = 'purchase'").select("owner", "fact"), told)


_TOXIC = "SELECT doc_id FROM labels WHERE toxic = 1"


@query(f"WITH {_WIN} SELECT document_id, count(*) AS chunks, sum(length(content))::BIGINT AS n_chars FROM win WHERE document_id NOT IN ({_TOXIC}) GROUP BY document_id", "mem")
def kb_delete_doc(t: Tables) -> DataFrame:
    """Chunks of a bucketed knowledge base after its toxic documents are deleted; only their buckets are rewritten."""
    chunks = chunker.windows(t.mem(), "id", "content").select(F.col("id").alias("document_id"), "chunk_index", "content")
    kb = BucketTable.create(chunks, scratch(t.spark, "kb"), "document_id")
    kb.delete(t.base("labels").where("toxic = 1").select(F.col("doc_id").alias("document_id")))
    return kb.rows().groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).cast("long").alias("n_chars"))


@query("SELECT user_id, name, total_orders, total_spent FROM users WHERE total_orders > 0", "users")
def profile_delete(t: Tables) -> DataFrame:
    """Profiles after those without an order are deleted from a bucketed table."""
    users = t.users().select("user_id", "name", "total_orders", "total_spent")
    held = BucketTable.create(users, scratch(t.spark, "profiles"), "user_id")
    held.delete(users.where("total_orders = 0").select("user_id"))
    return held.rows()


@query("SELECT p_partkey AS product_id, p_retailprice AS price, coalesce(i.stock, 0e0) AS stock, coalesce(i.related, []) AS related FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS stock, list_sort(list(DISTINCT l_suppkey)) AS related FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) i ON l_partkey = p_partkey")
def com_inventory(t: Tables) -> DataFrame:
    """Products whose inventory and relations are patched in place by what came back, and from which suppliers."""
    base = t.base("part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"), F.lit(0.0).alias("stock"), F.expr("CAST(array() AS array<bigint>)").alias("related"))
    held = BucketTable.create(base, scratch(t.spark, "products"), "product_id")
    back = t.base("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("product_id"))
    held.patch(back.agg(F.sum("l_quantity").alias("stock"), F.array_sort(F.collect_set("l_suppkey")).alias("related")))  # suppliers of a part are few
    return held.rows()


@query(
    f"""WITH u AS (SELECT session_id, content FROM msg WHERE role = 'user' AND length(content) > 20 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn) <= 5),
m AS (SELECT session_id, regexp_replace(content, '[^\\x00-\\x7F]', ' ', 'g') AS c FROM u), w AS (SELECT unnest({texts._TERMS}) AS w),
e AS (SELECT session_id, w[2] AS name, w[1] AS type FROM m, w WHERE contains(CASE WHEN w[1] = 'technology' THEN lower(c) ELSE c END, w[3])
UNION SELECT session_id, name, 'person' FROM (SELECT session_id, unnest(regexp_extract_all(c, {texts._SPAN}, 1)) AS name FROM m) WHERE length(name) > 2 AND name NOT IN ({texts._NAMES}))
SELECT 's' || session_id || '_' || name || '_' || type AS entity_id, name, type, 0.7e0 AS confidence FROM e""",
    "msg",
)
def kg_background(t: Tables) -> DataFrame:
    """Entities that the background stage stores: of a session's first five longer messages of its user, under ids of session, name and type."""
    said = t.msg().where("role = 'user'").select("session_id", "turn", F.regexp_replace("content", r"[^\x00-\x7F]", " ").alias("content"))
    return stores.background_entities(said, F.concat(F.lit("s"), "session_id"))


@query(
    r"""WITH s AS (SELECT session_id || ':' || turn AS id, list_filter(list_transform(regexp_split_to_array(content, '[。！？\n.!?]'), lambda x: trim(x)), lambda x: x <> '') AS x FROM msg),
f AS (SELECT id, list_slice(list_filter(list_transform(x, lambda y: substr(y, 1, 50)), lambda y, i: list_position(list_transform(x, lambda z: substr(z, 1, 50)), y) = i), 1, 5) AS facts FROM s),
w AS (SELECT id, facts, list_transform(facts, lambda y: least(0.5e0 + CASE WHEN regexp_matches(y, '[0-9]+') THEN 0.1e0 ELSE 0e0 END + CASE WHEN regexp_matches(y, '公司|项目|版本|姓名|电话|邮箱') THEN 0.2e0 ELSE 0e0 END + CASE WHEN regexp_matches(y, '决定|选择|使用|采用') THEN 0.15e0 ELSE 0e0 END, 1e0)) AS weights FROM f WHERE len(facts) > 0)
SELECT id, array_to_string(facts[1:3], '; ') AS summary, array_to_string(facts, ' | ') AS facts, array_to_string(facts[1:6], ' | ') AS keywords, round(list_sum(weights) / len(weights), 6) AS importance FROM w""",
    "msg",
)
def mem_enriched(t: Tables) -> DataFrame:
    """Summary, facts, keywords and mean importance of every message, by rules."""
    m = t.msg().select(F.concat_ws(":", "session_id", "turn").alias("id"), "content")
    return enrich.by_rules(m).select("id", "summary", F.array_join("facts", " | ").alias("facts"), F.array_join("keywords", " | ").alias("keywords"), "importance")


_SAID = """a AS (SELECT session_id, turn, regexp_extract(content, '[A-Z][a-z]+') AS brand, length(content) > 200 AS long, role FROM msg WHERE role IN ('user', 'assistant')),
v AS (SELECT session_id, turn, 'basic' AS grp, 'region' AS field, [role] AS value FROM a UNION ALL SELECT session_id, turn, 'interests', 'preferred_brands', [brand] FROM a WHERE brand <> ''
UNION ALL SELECT session_id, turn, 'consumption', 'price_sensitivity', [CASE WHEN long THEN 'high' ELSE 'low' END] FROM a)"""


@query(f"WITH {_SAID} SELECT session_id, grp, field, arg_max(value, turn)[1] AS value, 's' || session_id || ':' || max(turn) AS source FROM v GROUP BY session_id, grp, field", "msg")
def profile_from_talk(t: Tables) -> DataFrame:
    """Profile fields with their sources from structured answers to every turn; answers are JSON in prose, put together from the turn itself."""
    said = t.msg().where("role IN ('user', 'assistant')")
    brand = F.regexp_extract("content", "[A-Z][a-z]+", 0)
    told = F.to_json(F.struct(F.col("role").alias("region"), F.when(brand != "", F.array(brand)).alias("preferred_brands"), F.when(F.length("content") > 200, "high").otherwise("low").alias("price_sensitivity")))
    answers = said.select("session_id", "turn", F.concat(F.lit("As asked:\n```json\n"), told, F.lit("\n```")).alias("answer"))
    new = builders.updates(answers, "session_id", builders.USER_FIELDS, F.col("turn"), F.concat(F.lit("s"), "session_id", F.lit(":"), "turn"))
    return builders.built(new.where("false"), new, "session_id").select("session_id", "grp", "field", F.element_at("value", 1).alias("value"), "source")


@query("WITH l AS (SELECT user_id, relation FROM up QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20), n AS (SELECT user_id, relation, count(*) AS n FROM l GROUP BY ALL) SELECT user_id, array_to_string(list_sort(list(relation || ': ' || n)), ', ') AS insights FROM n GROUP BY user_id", "up")
def profile_insights(t: Tables) -> DataFrame:
    """Insights into each user's last twenty interactions, through the same answers."""
    answers = builders.behaviour_answers(t.up_edges())
    new = builders.updates(answers, "user_id", builders.USER_FIELDS, F.lit(0), F.lit("behaviour"))
    return builders.built(new.where("false"), new, "user_id").select("user_id", F.array_join("value", ", ").alias("insights"))


@query("SELECT m.id, agent_id, turn, role, length(s.content)::INT AS n_chars FROM mem m JOIN msg s ON s.session_id = m.id WHERE m.id = 3", "mem", "msg")
def point_lookup_raw(t: Tables) -> DataFrame:
    """A memory of any agent with the messages of its raw conversation, read from JSON."""
    said = t.msg().groupBy(F.col("session_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role", "content")))).alias("raw_conversation"))
    hit = stores.found(t.mem().select("id", "agent_id").join(said, "id"), "id", 3)
    return hit.select("id", "agent_id", F.explode("messages").alias("m")).select("id", "agent_id", "m.turn", "m.role", F.length("m.content").alias("n_chars"))


_NAMED = " OR ".join(f"contains(CASE WHEN {w[0]!r} = 'technology' THEN lower(c) ELSE c END, '{w[1]}')" for w in [*(("technology", x.lower()) for x in texts.entities.TECHNOLOGY), *(("", x) for x in (*texts.entities.ORGANISATIONS, *texts.entities.PLACES))])


@query(
    f"""WITH m AS (SELECT session_id, turn, regexp_replace(content, '[^\\x00-\\x7F]', ' ', 'g') AS full_text FROM msg), h AS (SELECT *, substr(full_text, 1, 2000) AS c FROM m),
e AS (SELECT *, {_NAMED} OR len(list_filter(regexp_extract_all(c, {texts._SPAN}, 1), lambda x: length(x) > 2 AND x NOT IN ({texts._NAMES}))) > 0 AS has FROM h)
SELECT session_id, turn, CASE WHEN length(full_text) >= 100 THEN 'large' WHEN has THEN 'small' ELSE 'small+large' END AS backend, has FROM e""",
    "msg",
)
def kg_routed(t: Tables) -> DataFrame:
    """Which extractors each message goes through, with the verify step for what the small one gives nothing for; rules stand in for both."""
    m = t.msg().select("session_id", "turn", F.regexp_replace("content", r"[^\x00-\x7F]", " ").alias("content"))
    return models.routed(m, "content", None, None, sure=0.7).select("session_id", "turn", "backend", (F.size("entities") > 0).alias("has"))


_EXT = "list_value('.png', '.mp3', '.mp4', '.pdf', '.zip', '.TXT', '')[(doc_id % 7 + 1)::BIGINT]"
_KIND = f"CASE {_EXT} WHEN '.png' THEN 'image' WHEN '.mp3' THEN 'audio' WHEN '.mp4' THEN 'video' WHEN '.pdf' THEN 'document' WHEN '.TXT' THEN 'document' WHEN '' THEN NULL ELSE 'other' END"


def media(t: Tables) -> DataFrame:
    """Memories as rows of a store of files of several kinds; those without a name have none."""
    ext = F.element_at(F.array(*map(F.lit, (".png", ".mp3", ".mp4", ".pdf", ".zip", ".TXT", ""))), (F.col("id") % 7 + 1).cast("int"))
    return t.mem().withColumn("content_type", F.when(ext != "", models.file_kind(F.concat(F.lit("file"), ext))))


@query(f"SELECT coalesce(k, 'text') AS content_type, count(*) AS n FROM (SELECT {_KIND} AS k FROM documents) GROUP BY 1")
def mm_types(t: Tables) -> DataFrame:
    return models.kind_counts(media(t))


@query(f"SELECT id, distance FROM dist JOIN documents ON doc_id = id WHERE {_KIND} = 'image' ORDER BY distance, id LIMIT 10", "mem", "qvec", "dist")
def mm_search(t: Tables) -> DataFrame:
    """The nearest rows of one kind: the kind is filtered before the nearest are taken."""
    from memloom.operators import vector

    images = media(t).where("content_type = 'image'").select("id").join(t.base("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    return vector.top_k(vector.with_distance(images, t.query_vector()), 10, "distance")


@query("SELECT c_custkey AS user_id, c_name AS name FROM customer ORDER BY 1 LIMIT 100")
def com_list_users(t: Tables) -> DataFrame:
    return t.base("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")).orderBy("user_id").limit(100)


@query("SELECT p_partkey AS product_id, p_name AS name FROM part ORDER BY 1 LIMIT 100")
def com_list_products(t: Tables) -> DataFrame:
    return t.base("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name")).orderBy("product_id").limit(100)
