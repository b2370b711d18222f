"""Commerce plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import commerce, vector
from memloom.plans.registry import query
from memloom.plans.views import Tables


@query("SELECT product_id, relation, weight, ts FROM up WHERE user_id = 7", "up")
def com_user_products(t: Tables) -> DataFrame:
    return t.up_edges().where("user_id = 7").select("product_id", "relation", "weight", "ts")


@query("SELECT user_id, relation, count(*) AS n FROM up WHERE product_id = 5 GROUP BY ALL", "up")
def com_product_users(t: Tables) -> DataFrame:
    return t.up_edges().where("product_id = 5").groupBy("user_id", "relation").agg(F.count("*").alias("n"))


_UU = "(SELECT DISTINCT a.user_id AS source, b.user_id AS target FROM up a JOIN up b ON a.product_id = b.product_id AND a.user_id < b.user_id WHERE a.relation = 'purchased' AND b.relation = 'purchased')"


@query(f"SELECT DISTINCT CASE WHEN source = 7 THEN target ELSE source END AS user_id FROM {_UU} WHERE source = 7 OR target = 7", "up")
def com_similar_users(t: Tables) -> DataFrame:
    """The other end of each user-user edge at a user; edges are purchases of the same product, from that user's side only."""
    bought = t.up_edges().where("relation = 'purchased'").select("user_id", "product_id").distinct()
    mine = bought.where("user_id = 7").select("product_id")
    return bought.where("user_id <> 7").join(mine, "product_id", "left_semi").select("user_id").distinct()


_REC = """r AS (SELECT u.user_id, p.target AS product_id, round(sum(u.weight * p.weight * CASE p.relation WHEN 'similar' THEN 0.8e0 WHEN 'complementary' THEN 1.2e0 ELSE 0.5e0 END), 6) + 0e0 AS score
FROM (SELECT user_id, product_id, round(sum(weight), 6) AS weight FROM up GROUP BY ALL) u JOIN pp p ON p.source = u.product_id GROUP BY ALL),
f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.user_id = r.user_id AND up.product_id = r.product_id AND up.relation = 'purchased'))"""


def recommended(t: Tables, up: DataFrame, most: int) -> DataFrame:
    return commerce.recommend_best(up, t.brands(), t.pp_near(), commerce.MULTIPLIERS["similar"], most)


@query(f"WITH {_REC} SELECT user_id, product_id, score FROM f", "up", "pp")
def com_recommend(t: Tables) -> DataFrame:
    """Each user's scores of all products; a brand's products are related through the brand, pair by pair nowhere."""
    return commerce.recommend_all(t.up_edges(), t.brands(), t.pp_near(), commerce.MULTIPLIERS["similar"])


@query(f"WITH {_REC} SELECT f.product_id, score, name, brand, price FROM f LEFT JOIN products USING (product_id) WHERE user_id = 7 ORDER BY score DESC, product_id LIMIT 10", "up", "pp", "products")
def com_recommend_enriched(t: Tables) -> DataFrame:
    best = recommended(t, t.up_edges().where("user_id = 7"), 10).select("product_id", "score")
    return best.join(t.base("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price")), "product_id", "left")


@query("SELECT product_id, count(DISTINCT user_id) AS n FROM up WHERE relation = 'purchased' AND product_id <> 5 AND user_id IN (SELECT user_id FROM up WHERE relation = 'purchased' AND product_id = 5) GROUP BY product_id", "up")
def com_bought_together(t: Tables) -> DataFrame:
    return commerce.bought_together(t.up_edges(), 5)


@query("SELECT product_id, relation, weight FROM up WHERE user_id = 7 AND weight >= 0.5 ORDER BY weight DESC, product_id, event_id LIMIT 10", "up")
def com_user_interests(t: Tables) -> DataFrame:
    return t.up_edges().where("user_id = 7 AND weight >= 0.5").orderBy(F.desc("weight"), "product_id", "event_id").limit(10).select("product_id", "relation", "weight")


@query("SELECT product_id, count(*) AS interactions, count(DISTINCT user_id) AS users, count(*) FILTER (relation = 'purchased') AS purchased, count(*) FILTER (relation = 'viewed') AS viewed, any_value(k.n) AS related FROM up LEFT JOIN (SELECT source, count(*) AS n FROM pp GROUP BY source) k ON k.source = product_id GROUP BY product_id", "up", "pp")
def com_product_perf(t: Tables) -> DataFrame:
    by = lambda r: F.count_if(F.col("relation") == r)
    perf = t.up_edges().groupBy("product_id").agg(F.count("*").alias("interactions"), F.count_distinct("user_id").alias("users"), by("purchased").alias("purchased"), by("viewed").alias("viewed"))
    return perf.join(t.pp_counts(), "product_id", "left")


@query("SELECT brand, c AS category, count(*) AS n, round(avg(avg_rating) FILTER (avg_rating > 0), 6) AS rating, round(sum(monthly_sales), 2) AS sales FROM (SELECT *, unnest(category) AS c FROM products) GROUP BY ALL", "products")
def com_product_stats(t: Tables) -> DataFrame:
    p = t.products().select("brand", F.explode("category").alias("category"), "avg_rating", "monthly_sales")
    return p.groupBy("brand", "category").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("avg_rating") > 0, F.col("avg_rating"))), 6).alias("rating"), F.round(F.sum("monthly_sales"), 2).alias("sales"))


@query("SELECT CASE WHEN v <= 50 THEN '0-50' WHEN v <= 100 THEN '50-100' WHEN v <= 300 THEN '100-300' WHEN v <= 500 THEN '300-500' ELSE '500+' END AS bucket, count(*) AS n FROM (SELECT price / (1 + product_id % 30) AS v FROM products) GROUP BY 1", "products")
def com_price_buckets(t: Tables) -> DataFrame:
    """Prices of lots of one to thirty pieces, as the parts' own prices all lie in the last bucket."""
    p = t.base("part").select(commerce.price_bucket(F.col("p_retailprice") / (1 + F.col("p_partkey") % 30)).alias("bucket"))
    return p.groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT product_id, name FROM products WHERE list_contains(category, 'ECONOMY') ORDER BY product_id LIMIT 100", "products")
def com_category(t: Tables) -> DataFrame:
    p = t.base("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.array("p_type").alias("category"))
    return p.where(F.array_contains("category", "ECONOMY")).orderBy("product_id").limit(100).select("product_id", "name")


@query("SELECT d.id AS user_id, coalesce(name, '') AS name, coalesce(total_orders, 0) AS total_orders, coalesce(total_spent, 0e0) AS total_spent, name IS NULL AS is_default FROM (SELECT DISTINCT user_id + 1400 AS id FROM events) d LEFT JOIN users ON user_id = id", "users")
def com_user_profile(t: Tables) -> DataFrame:
    """Profiles of all users with events, with defaults for those who have none (ids are shifted past the last profile to make some)."""
    asked = t.base("events").select((F.col("user_id") + 1400).alias("user_id")).distinct()
    u = asked.join(t.users(), "user_id", "left")
    return u.select("user_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("total_orders", F.lit(0)).alias("total_orders"), F.coalesce("total_spent", F.lit(0.0)).alias("total_spent"), F.col("name").isNull().alias("is_default"))


@query("SELECT product_id, concat_ws(' ', name, '类目:' || category[1], '品牌:' || brand) AS text FROM products", "products")
def com_profile_text(t: Tables) -> DataFrame:
    p = t.base("part")
    return p.select(F.col("p_partkey").alias("product_id"), commerce.labelled([("", F.col("p_name")), ("类目:", F.col("p_type")), ("品牌:", F.col("p_brand"))]).alias("text"))


_OLD = "(SELECT user_id, segment, [segment, 'x'] AS tags FROM users)"
_NEW = "(SELECT o_custkey AS user_id, CASE WHEN count(*) > 12 THEN 'VIP' END AS segment, ['x', 'buyer'] AS tags FROM orders GROUP BY 1)"


@query(f"SELECT user_id, coalesce(n.segment, o.segment) AS segment, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.tags, []), coalesce(n.tags, [])))), ',') AS tags FROM {_OLD} o FULL JOIN {_NEW} n USING (user_id)", "users")
def com_profile_merge(t: Tables) -> DataFrame:
    """Customers' profiles with a batch from their orders."""
    old = t.base("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")).withColumn("tags", F.array("segment", F.lit("x")))
    new = t.base("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.when(F.count("*") > 12, "VIP").alias("segment")).withColumn("tags", F.array(F.lit("x"), F.lit("buyer")))
    return commerce.merged(old, new, "user_id", ("tags",)).withColumn("tags", F.array_join("tags", ","))


@query("SELECT id AS product_id, round(1 - distance, 6) AS similarity FROM dist WHERE id <> 0 ORDER BY similarity DESC, product_id LIMIT 10", "mem", "qvec", "dist")
def com_similar_products(t: Tables) -> DataFrame:
    near = vector.with_distance(t.base("embeddings").select(F.col("vec_id").alias("id"), "embedding").where("id <> 0").join(t.base("documents").select(F.col("doc_id").alias("id")), "id", "left_semi"), t.query_vector())
    return vector.top_k(near.select(F.col("id").alias("product_id"), F.round(1 - F.col("distance"), 6).alias("similarity")), 10, F.desc("similarity"), tie="product_id")


@query("SELECT p.product_id, p.name, round(1 - d.distance, 6) AS score FROM products p JOIN dist d ON d.id = p.product_id WHERE list_contains(category, 'ECONOMY') ORDER BY score DESC, product_id LIMIT 10", "mem", "qvec", "dist", "products")
def com_product_search(t: Tables) -> DataFrame:
    p = t.base("part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    v = t.vectors().select(F.col("id").alias("product_id"), "embedding")
    near = vector.with_distance(p.join(v, "product_id"), t.query_vector())
    return vector.top_k(near.select("product_id", "name", F.round(1 - F.col("distance"), 6).alias("score")), 10, F.desc("score"), tie="product_id")


_TAGS = """SELECT user_id, array_to_string(list_filter([CASE WHEN total_spent > 10000 THEN '高消费用户' WHEN total_spent > 5000 THEN '中高消费用户' WHEN total_spent > 1000 THEN '中等消费用户' END, CASE WHEN total_orders > 20 THEN '高频购买' WHEN total_orders > 10 THEN '活跃用户' END, CASE WHEN f > 10 THEN '收藏达人' END, CASE WHEN c > 2 * p THEN '加购未购' END, CASE WHEN nation % 3 = 0 THEN '价格敏感' WHEN nation % 3 = 1 THEN '品质优先' END], lambda x: x IS NOT NULL), ',') AS tags
FROM (SELECT u.*, coalesce(b.f, 0) AS f, coalesce(b.c, 0) AS c, coalesce(b.p, 0) AS p FROM users u LEFT JOIN (SELECT user_id, count(*) FILTER (relation = 'favorited') AS f, count(*) FILTER (relation = 'cart_added') AS c, count(*) FILTER (relation = 'purchased') AS p FROM up GROUP BY user_id) b USING (user_id))"""


@query(_TAGS, "users", "up")
def com_auto_tag_user(t: Tables) -> DataFrame:
    by = lambda r: F.count_if(F.col("relation") == r)
    b = t.up_edges().groupBy("user_id").agg(by("favorited").alias("f"), by("cart_added").alias("c"), by("purchased").alias("p"))
    u = t.users().join(b, "user_id", "left").fillna(0, ["f", "c", "p"])
    mood = F.when(F.col("nation") % 3 == 0, "high").when(F.col("nation") % 3 == 1, "low")
    return u.select("user_id", F.array_join(commerce.user_tags(F.col("total_spent"), F.col("total_orders"), F.col("f"), F.col("c"), F.col("p"), mood), ",").alias("tags"))


@query("SELECT product_id, array_to_string(list_filter([CASE WHEN monthly_sales > 1000 THEN '爆款' WHEN monthly_sales > 500 THEN '热销' END, CASE WHEN avg_rating >= 4.8 THEN '好评如潮' WHEN avg_rating >= 4.5 THEN '口碑好' END, CASE WHEN price < (price + 10e0 * product_id) * 0.5e0 THEN '超值' END], lambda x: x IS NOT NULL), ',') AS tags FROM products", "products")
def com_auto_tag_product(t: Tables) -> DataFrame:
    c = F.col
    return t.products().select("product_id", F.array_join(commerce.product_tags(c("monthly_sales"), c("avg_rating"), c("price"), c("price") + 10.0 * c("product_id")), ",").alias("tags"))


@query("SELECT c_custkey AS user_id, count(o_orderkey) AS total_orders, round(coalesce(sum(o_totalprice), 0e0), 2) AS total_spent, max(o_orderdate) AS last_active FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def com_import_orders(t: Tables) -> DataFrame:
    p = t.base("customer").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("total_orders"), F.lit(0.0).alias("total_spent"))
    o = t.base("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("total_amount"), F.col("o_orderdate").alias("order_time"))
    return commerce.order_import(p, o)


@query("SELECT user_id, count(*) AS relations, count(*) FILTER (event_type = 'purchase') AS purchases, round(sum(value) FILTER (event_type = 'purchase'), 2) AS spent FROM events GROUP BY user_id")
def com_import_behaviors(t: Tables) -> DataFrame:
    bought = F.col("event_type").isin("purchase", "purchased")
    return t.base("events").groupBy("user_id").agg(F.count("*").alias("relations"), F.count_if(bought).alias("purchases"), F.round(F.sum(F.when(bought, F.col("value"))), 2).alias("spent"))


@query("SELECT count(*) FILTER (k IS NOT NULL AND k NOT IN (SELECT o_custkey FROM orders)) AS imported, count(*) FILTER (k IN (SELECT o_custkey FROM orders)) AS updated, count(*) FILTER (k IS NULL) AS failed, count(*) AS total FROM (SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey END AS k FROM customer)")
def com_batch_import(t: Tables) -> DataFrame:
    """Customers as the batch, those in debt without an id; buyers are known already."""
    new = t.base("customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("user_id"))
    return commerce.import_counts(t.base("orders").select(F.col("o_custkey").alias("user_id")), new, "user_id")
