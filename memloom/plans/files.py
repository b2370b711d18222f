"""Plans that write the tables out as the files that sources read, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.buckets import BucketTable
from memloom.operators.shared import scratch
from memloom.plans.registry import query
from memloom.plans.views import Tables
from memloom.sources import crm, graph_files

_USERS = "SELECT user_id::VARCHAR AS user_id, name, segment AS region, total_spent, total_orders::INT AS total_orders FROM users"


def profiles(rows: DataFrame) -> DataFrame:
    p, _ = crm.profiles(rows)
    return p.select("user_id", "basic.name", "basic.region", "consumption.total_spent", "consumption.total_orders")


@query(_USERS, "users")
def src_csv_profiles(t: Tables) -> DataFrame:
    """All users through CSV files whose fields come under other names."""
    to = scratch(t.spark, "crm")
    named = t.users().select(F.col("user_id").alias("客户ID"), F.col("name").alias("姓名"), F.col("segment").alias("地区"), F.col("total_spent").alias("累计消费"), F.col("total_orders").alias("购买次数"))
    named.write.csv(to, header=True)
    return profiles(crm.read_csv(t.spark, to))


@query(_USERS, "users")
def src_json_profiles(t: Tables) -> DataFrame:
    """All users through JSON files, a list in each."""
    to = scratch(t.spark, "crm")
    row = F.struct(F.col("user_id").alias("member_id"), F.col("name").alias("real_name"), F.col("segment").alias("city"), F.col("total_spent").alias("lifetime_value"), F.col("total_orders").alias("order_count"))
    lists = t.users().select(F.floor(F.col("user_id") / 500).alias("part"), row.alias("r")).groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value"))  # 500 users a file
    lists.select("value").write.option("maxRecordsPerFile", 1).text(to)
    return profiles(crm.read_json(t.spark, to))


@query("SELECT source, relation, target, confidence FROM kg", "kg")
def src_graph_file(t: Tables) -> DataFrame:
    """The graph through JSON files of nodes and edges, one for each target and thousand sources."""
    to = scratch(t.spark, "graph")
    attrs = F.create_map(F.lit("relation"), "relation", F.lit("confidence"), F.col("confidence").cast("string"))
    edge = F.struct("source", "target", attrs.alias("attrs"))
    part = F.pmod(F.xxhash64("source"), F.lit(16))
    g = t.kg().groupBy("target", part.alias("part")).agg(F.collect_list(edge).alias("edges"))
    node = lambda x: F.struct(x.alias("id"), F.create_map(F.lit("type"), F.lit("place")).alias("attrs"))
    whole = F.struct(F.array(node(F.col("target"))).alias("nodes"), "edges")
    g.select(F.to_json(whole).alias("value")).write.option("maxRecordsPerFile", 1).text(to)
    return graph_files.read_graph(t.spark, to)[1].select("source", "relation", "target", "confidence")


@query("SELECT id, agent_id, md5(content) AS hash FROM mem", "mem")
def src_agent_export(t: Tables) -> DataFrame:
    """All memories through an agent's export; those already held stay as they are."""
    to = scratch(t.spark, "export")
    m = t.mem().select("id", "content", "agent_id")
    graph_files.export_agent(m, t.kg(), to)
    held = m.join(t.base("labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return graph_files.import_agent(t.spark, to, held).select("id", "agent_id", F.md5("content").alias("hash"))


@query("SELECT md5(session_id || ':' || turn) AS id, session_id, role, md5(content) AS hash FROM msg", "msg")
def mem_insert_batch(t: Tables) -> DataFrame:
    """Messages put into a bucketed table in batches that overlap: ids are hashes, so that a batch that comes again changes nothing."""
    m = t.msg().select(F.md5(F.concat_ws(":", "session_id", "turn")).alias("id"), "session_id", "role", "content")
    held = BucketTable.create(m.where("role = 'user'"), scratch(t.spark, "memories"), "id", buckets=8)
    held.replace(m)
    held.replace(m.where("role = 'assistant'"))
    return held.rows().select("id", "session_id", "role", F.md5("content").alias("hash"))
