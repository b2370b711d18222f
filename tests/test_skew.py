"""Joins and lists under hot keys: heavy mids, users and brands."""

import random
from collections import defaultdict

import pytest

from memloom.operators import commerce, graph, skew


def test_product_join_is_the_join(spark):
    r = random.Random(0)
    a = [(r.choice(["hot", "hot", "hot", f"k{i % 40}", None]), i) for i in range(400)]
    b = [(r.choice(["hot", "hot", f"k{i % 40}", None]), i) for i in range(300)]
    x, y = spark.createDataFrame(a, "k string, x int"), spark.createDataFrame(b, "k string, y int")
    want = sorted((k, i, j) for k, i in a for m, j in b if k is not None and k == m)
    for side in (5, 50, 2000):
        assert sorted(map(tuple, skew.product_join(x, y, ["k"], "x", "y", side).collect())) == want


def test_no_task_gets_a_heavy_key(spark):
    """Half of all edges at one node: no cell of the grid holds more than about a task's share."""
    x = spark.range(20_000).selectExpr("IF(id % 2 = 0, 0, id) AS k", "id AS x")
    y = spark.range(20_000).selectExpr("IF(id % 2 = 0, 0, id) AS k", "id AS y")
    plan = skew.product_join(x, y, ["k"], "x", "y", side=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "_line" in plan and "_column" in plan
    cells = x.where("k = 0").selectExpr("pmod(xxhash64(x), 10) AS line").groupBy("line").count().agg({"count": "max"}).first()[0]
    assert cells < 1.2 * 1000


def test_infer_with_a_hot_mid_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(skew.product_join, "__defaults__", (8,))
    r = random.Random(1)
    rows = {(f"a{r.randrange(60)}", "IsA", "hub"): 0.5 + r.randrange(50) / 100 for _ in range(80)}
    rows |= {("hub", "IsA", f"b{r.randrange(60)}"): 0.5 + r.randrange(50) / 100 for _ in range(80)}
    rows |= {(f"a{r.randrange(60)}", r.choice(["IsA", "Uses"]), f"a{r.randrange(60)}"): 0.9 for _ in range(80)}
    kg = spark.createDataFrame([(*k, c) for k, c in rows.items()], "source string, relation string, target string, confidence double")
    known, want = {(s, t) for s, _, t in rows}, {}
    for (s, p, m), c in rows.items():
        for (m2, p2, t), d in rows.items():
            if p == p2 == "IsA" and m == m2 and s != t and (s, t) not in known:
                want[s, p, t] = max(want.get((s, p, t), 0), round(min(c, d) * 0.8, 6))
    assert {(x.source, x.relation, x.target): x.confidence for x in graph.infer(kg, ["IsA"]).collect()} == pytest.approx(want)


@pytest.mark.parametrize(("seed", "most"), [(0, 20), (1, 3), (2, 1), (3, 60)])
def test_best_recommendations_are_those_of_all_pairs(spark, seed, most):
    r = random.Random(seed)
    brand = {p: r.choice(["x", "x", "y", "z", None, f"own{p}"]) for p in range(80)}
    up = [(r.randrange(6) if r.random() < 0.7 else 99, r.choice([*range(80), 500]), *r.choice(list(commerce_weights().items()))) for _ in range(160)]
    near = [(a, r.randrange(80), r.choice(["complementary", "competitor", "unknown"]), r.choice([1.0, 0.5])) for a in range(80) for _ in range(r.randrange(2))]
    pairs = [(a, b, "similar", 1.0) for a in brand for b in brand if a != b and brand[a] is not None and brand[a] == brand[b]]
    ups = spark.createDataFrame(up, "user_id int, product_id int, relation string, weight double")
    form = "source int, target int, relation string, weight double"
    members = spark.createDataFrame(list(brand.items()), "product_id int, grp string")
    got = defaultdict(list)
    for x in commerce.recommend_best(ups, members, spark.createDataFrame(near, form), 0.8, most).collect():
        got[x.user_id].append((-x.score, x.product_id))
    want = defaultdict(list)
    for x in commerce.recommend(ups, spark.createDataFrame(pairs + near, form)).collect():
        want[x.user_id].append((-x.score, x.product_id))
    assert {u: sorted(v) for u, v in got.items()} == {u: sorted(v)[:most] for u, v in want.items()}


@pytest.mark.parametrize(("seed", "size", "side"), [(0, 256, 100), (1, 5, 1), (2, 1, 2), (3, 16, 1)])
def test_all_recommendations_are_those_of_all_pairs(spark, seed, size, side, monkeypatch):
    monkeypatch.setattr(commerce, "LIST", size)
    monkeypatch.setattr(commerce, "SIDE", side)
    r = random.Random(seed)
    brand = {p: r.choice(["x", "x", "y", "z", None, f"own{p}"]) for p in range(80)}
    up = [(r.randrange(6) if r.random() < 0.7 else 99, r.choice([*range(80), 500, None]), *r.choice(list(commerce_weights().items()))) for _ in range(160)]
    near = [(a, r.randrange(80), r.choice(["complementary", "competitor", "unknown"]), r.choice([1.0, 0.5])) for a in range(80) for _ in range(r.randrange(2))]
    pairs = [(a, b, "similar", 1.0) for a in brand for b in brand if a != b and brand[a] is not None and brand[a] == brand[b]]
    ups = spark.createDataFrame(up, "user_id int, product_id int, relation string, weight double")
    form = "source int, target int, relation string, weight double"
    members = spark.createDataFrame(list(brand.items()), "product_id int, grp string")
    got = sorted((x.user_id, x.product_id, x.score) for x in commerce.recommend_all(ups, members, spark.createDataFrame(near, form), 0.8).collect())
    want = sorted((x.user_id, x.product_id, x.score) for x in commerce.recommend(ups, spark.createDataFrame(pairs + near, form)).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)


def commerce_weights():
    return {"viewed": 0.1, "cart_added": 0.3, "purchased": 1.0, "returned": -0.5, "reviewed": 0.8}


def shuffled(plan):
    """Rows that each shuffle of a plan that ran has written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    below = plan.children()
    out = [n for k in range(below.size()) for n in shuffled(below.apply(k))]
    return out + ([plan.metrics().apply("shuffleRecordsWritten").value()] if kind == "ShuffleExchangeExec" else [])


def test_no_pair_of_a_sum_and_a_list_is_shuffled(spark, monkeypatch):
    """60 users meet 300 lists of a product or two; before, each of these pairs was a row that two joins shuffled."""
    monkeypatch.setattr(commerce, "LIST", 1)
    ups = spark.createDataFrame([(u, u % 3, "viewed", 0.1) for u in range(60)], "user_id int, product_id int, relation string, weight double")
    members = spark.range(300).selectExpr("CAST(id AS INT) AS product_id", "'x' AS grp")
    edges = spark.createDataFrame([], "source int, target int, relation string, weight double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = commerce.recommend_all(ups, members, edges, 0.8)
        assert len(df.collect()) == 60 * 299
        assert 0 < max(shuffled(df._jdf.queryExecution().executedPlan())) < 60 * 300 / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_a_user_are_scored_alike(spark):
    """SQL sums them as one user, who has bought nothing as no key equals theirs."""
    ups = spark.createDataFrame([(None, 1, "purchased", 1.0), (None, 2, "viewed", 0.1), (7, 1, "purchased", 1.0), (7, 2, "viewed", 0.1)], "user_id int, product_id int, relation string, weight double")
    members = spark.createDataFrame([(p, "x") for p in range(1, 5)], "product_id int, grp string")
    near = spark.createDataFrame([(2, 3, "complementary", 1.0)], "source int, target int, relation string, weight double")
    got = {(x.user_id, x.product_id): x.score for x in commerce.recommend_all(ups, members, near, 0.8).collect()}
    score = {1: 0.08, 2: 0.8, 3: 1.0, 4: 0.88}
    assert got == pytest.approx({(u, p): s for u in (None, 7) for p, s in score.items() if (u, p) != (7, 1)}, abs=2e-6)
