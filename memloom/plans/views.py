"""The engine's tables as views of the driver's Parquet tables: once as DataFrames, once as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REF_TIME = "2024-01-31 00:00:00"
#: The lexical query of the retrieval plans.
TERMS = ("elle", "ment", "the")


class Tables:
    """Lazy access to base tables and views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})

    def mem(self, *need: str) -> DataFrame:
        """Memories; only the joins for the named columns (embedding, ts, importance) are made."""
        d = self.base("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.substring("text", 1, 150).alias("summary"), F.col("source").alias("agent_id"), F.col("lang").alias("memory_type"))
        if "embedding" in need:
            d = d.join(self.base("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
        if "ts" in need:
            d = d.join(self.base("events").select(F.col("event_id").alias("id"), "ts"), "id", "left")
        if "importance" in need:
            rated = self.base("labels").select(F.col("doc_id").alias("id"), F.expr("0.4D + 0.4D * quality - 0.2D * toxic").alias("importance"))
            d = d.join(rated, "id", "left").withColumn("importance", F.coalesce("importance", F.lit(0.5)))
        return d

    def vectors(self, *need: str) -> DataFrame:
        """Memories that have a vector; the narrow side leads, so that vectors are joined after pruning."""
        return self.mem("embedding", *need).where("embedding IS NOT NULL")

    def query_vector(self) -> list[float]:
        """The vector of vec_id 0: a query's constant, one row."""
        return list(self.base("embeddings").where("vec_id = 0").select("embedding").first()[0])

    def msg(self) -> DataFrame:
        ts = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(conv_id AS INT), CAST(turn AS INT), 0)")
        return self.base("conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"), ts.alias("ts"))

    def kg(self) -> DataFrame:
        """Triples (source, relation, target, confidence)."""
        n, r, c, s = self.base("nation"), self.base("region"), self.base("customer"), self.base("supplier")
        named = n.select("n_nationkey", "n_name")
        part = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("source"), F.lit("PartOf").alias("relation"), F.col("r_name").alias("target"), F.lit(0.9).alias("confidence"))
        cust = c.join(F.broadcast(named), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("source"), F.lit("LocatedIn").alias("relation"), F.col("n_name").alias("target"), F.lit(0.7).alias("confidence"))
        supp = s.join(F.broadcast(named), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.lit("LocatedIn").alias("relation"), F.col("n_name").alias("target"), F.lit(0.8).alias("confidence"))
        return part.unionByName(cust).unionByName(supp)

    def kg_ev(self) -> DataFrame:
        """Distinct (user, event type, k) triples with the best confidence."""
        e = self.base("events").select(F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_type").alias("relation"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("target"), F.round(F.least(F.col("value") / 500, F.lit(1.0)), 6).alias("confidence"))
        return e.groupBy("source", "relation", "target").agg(F.max("confidence").alias("confidence"))

    def up_edges(self) -> DataFrame:
        e = self.base("events")
        kind = F.create_map(*(F.lit(x) for kv in EVENT_RELATIONS.items() for x in kv))
        rel = kind[F.col("event_type")]
        weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
        return e.select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("product_id"), rel.alias("relation"), F.coalesce(weight[rel], F.lit(0.1)).alias("weight"))

    def pp_edges(self, sources: DataFrame | None = None) -> DataFrame:
        """Relations between products: of one brand, or of one type with neighbouring keys. `sources` (product_id) bounds the source end alone."""
        p = self.base("part").select("p_partkey", "p_brand", "p_type")
        a, b = (p.select(*(F.col(c).alias(f"{s}_{c}") for c in p.columns)) for s in "ab")
        if sources is not None:
            a = a.join(sources.select(F.col("product_id").alias("a_p_partkey")).distinct(), "a_p_partkey", "left_semi")
        same = a.join(b, (F.col("a_p_brand") == F.col("b_p_brand")) & (F.col("a_p_partkey") != F.col("b_p_partkey")))
        beside = a.withColumn("beside", F.explode(F.array(F.col("a_p_partkey") - 1, F.col("a_p_partkey") + 1)))
        near = beside.join(b, (F.col("a_p_type") == F.col("b_p_type")) & (F.col("beside") == F.col("b_p_partkey")))
        pick = lambda d, r: d.select(F.col("a_p_partkey").alias("source"), F.lit(r).alias("relation"), F.col("b_p_partkey").alias("target"), F.lit(1.0).alias("weight"))
        return pick(same, "similar").unionByName(pick(near, "complementary"))

    def pp_near(self) -> DataFrame:
        """The relations of pp_edges between neighbouring keys; those of one brand are `brands`."""
        p = self.base("part").select("p_partkey", "p_type")
        beside = p.select("p_type", F.col("p_partkey").alias("source"), F.explode(F.array(F.col("p_partkey") - 1, F.col("p_partkey") + 1)).alias("p_partkey"))
        return beside.join(p, ["p_partkey", "p_type"]).select("source", F.lit("complementary").alias("relation"), F.col("p_partkey").alias("target"), F.lit(1.0).alias("weight"))

    def brands(self) -> DataFrame:
        return self.base("part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("grp"))

    def pp_counts(self) -> DataFrame:
        """(product_id, related): how many pp_edges leave each product, from brands' sizes and neighbours; no pairs of a brand are listed."""
        p = self.base("part").select("p_partkey", "p_brand", "p_type")
        same = p.join(p.groupBy("p_brand").agg((F.count("*") - 1).alias("n")), "p_brand").select("p_partkey", "n")
        beside = p.select((F.col("p_partkey") + 1).alias("p_partkey"), "p_type").unionAll(p.select((F.col("p_partkey") - 1).alias("p_partkey"), "p_type"))
        near = p.join(beside, ["p_partkey", "p_type"]).select("p_partkey", F.lit(1).cast("long").alias("n"))
        return same.unionByName(near).groupBy(F.col("p_partkey").alias("product_id")).agg(F.sum("n").alias("related")).where("related > 0")

    def products(self) -> DataFrame:
        sold = self.base("lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.sum("l_quantity").alias("monthly_sales"))
        p = self.base("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.array("p_type").alias("category"), F.col("p_retailprice").alias("price"), (F.col("p_size") / 10.0).alias("avg_rating"))
        return p.join(sold, "product_id", "left").withColumn("monthly_sales", F.coalesce("monthly_sales", F.lit(0.0)))

    def users(self) -> DataFrame:
        o = self.base("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("total_orders"), F.round(F.sum("o_totalprice"), 2).alias("total_spent"))
        c = self.base("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
        return c.join(o, "user_id", "left").withColumns({"total_orders": F.coalesce("total_orders", F.lit(0)), "total_spent": F.coalesce("total_spent", F.lit(0.0))})


#: What each event type stands for, and the weights of user-product relations.
EVENT_RELATIONS = {"view": "viewed", "click": "cart_added", "purchase": "purchased", "signup": "favorited", "error": "returned"}
WEIGHTS = {"viewed": 0.1, "cart_added": 0.3, "favorited": 0.4, "purchased": 1.0, "reviewed": 0.8, "shared": 0.6, "returned": -0.5}

#: The same views in DuckDB's SQL; each may use those before it.
SQL = {
    "mem": "SELECT d.doc_id AS id, d.text AS content, substr(d.text, 1, 150) AS summary, d.source AS agent_id, d.lang AS memory_type, v.embedding, e.ts, coalesce(0.4e0 + 0.4e0 * l.quality - 0.2e0 * l.toxic, 0.5e0) AS importance FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "qvec": "SELECT embedding AS q FROM embeddings WHERE vec_id = 0",
    "dist": "SELECT id, content, summary, agent_id, memory_type, ts, importance, round(1e0 - list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 6) AS distance FROM mem, qvec WHERE embedding IS NOT NULL",
    "toks": r"SELECT id, regexp_extract_all(lower(content), '\p{L}+|\p{Nd}+') AS t FROM mem",
    "tf": "SELECT id, len(t) AS dl, [len(list_filter(t, lambda x: x = 'elle')), len(list_filter(t, lambda x: x = 'ment')), len(list_filter(t, lambda x: x = 'the'))] AS f FROM toks",
    "st": "SELECT count(*) AS n, avg(dl) AS a, [count(*) FILTER (f[1] > 0), count(*) FILTER (f[2] > 0), count(*) FILTER (f[3] > 0)] AS df FROM tf",
    "bm25": "SELECT id, round(" + " + ".join(f"ln(1e0 + (n - df[{k}] + 0.5e0) / (df[{k}] + 0.5e0)) * f[{k}] * 2.2e0 / (f[{k}] + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))" for k in (1, 2, 3)) + ", 6) AS score FROM tf, st WHERE f[1] + f[2] + f[3] > 0",
    "msg": "SELECT conv_id AS session_id, turn, role, text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts FROM conversations",
    "kg": "SELECT n_name AS source, 'PartOf' AS relation, r_name AS target, 0.9e0 AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, 'LocatedIn', n_name, 0.7e0 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, 'LocatedIn', n_name, 0.8e0 FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "kg_ev": "SELECT 'u' || user_id AS source, event_type AS relation, 'k' || (props->>'$.k') AS target, max(round(least(value / 500, 1e0), 6)) AS confidence FROM events GROUP BY ALL",
    "up": "SELECT event_id, ts, user_id, (props->>'$.k')::BIGINT AS product_id, CASE event_type WHEN 'view' THEN 'viewed' WHEN 'click' THEN 'cart_added' WHEN 'purchase' THEN 'purchased' WHEN 'signup' THEN 'favorited' WHEN 'error' THEN 'returned' END AS relation, CASE event_type WHEN 'view' THEN 0.1e0 WHEN 'click' THEN 0.3e0 WHEN 'purchase' THEN 1e0 WHEN 'signup' THEN 0.4e0 WHEN 'error' THEN -0.5e0 ELSE 0.1e0 END AS weight FROM events",
    "pp": "SELECT a.p_partkey AS source, 'similar' AS relation, b.p_partkey AS target, 1e0 AS weight FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey UNION ALL SELECT a.p_partkey, 'complementary', b.p_partkey, 1e0 FROM part a JOIN part b ON a.p_type = b.p_type AND abs(a.p_partkey - b.p_partkey) = 1",
    "products": "SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, [p_type] AS category, p_retailprice AS price, p_size / 10e0 AS avg_rating, coalesce(s.q, 0e0) AS monthly_sales FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey",
    "users": "SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation, coalesce(o.n, 0) AS total_orders, coalesce(o.s, 0e0) AS total_spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1) o ON o_custkey = c_custkey",
}


def oracle(body: str, *views: str) -> str:
    """DuckDB SQL with the named views, in the order of SQL, before it."""
    used = [v for v in SQL if v in views]
    if not used:
        return body
    body = body.strip()
    more = body.startswith("WITH ")
    recursive = body.startswith("WITH RECURSIVE ")
    rest = body[15:] if recursive else body[5:] if more else body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{v} AS ({SQL[v]})" for v in used) + (", " if more else " ") + rest
