"""Recall from question to context, Markdown extraction, upkeep of the graph, schedules."""

import datetime as dt

from pyspark.sql import functions as F

from memloom.functions import markdown
from memloom.operators import commerce, graph
from memloom.plans import recall
from memloom.streaming import schedule

NOW = dt.datetime(2024, 1, 31, 12)


def store(spark):
    rows = [(i, f"message {i} about {'cats' if i % 2 else 'dogs'}。It is 张三负责项目。", 0.5, NOW - dt.timedelta(days=i), [1.0, float(i)]) for i in range(1, 20)]
    return spark.createDataFrame(rows, "id long, content string, importance double, ts timestamp, embedding array<double>")


def test_retrieve(spark):
    m = store(spark)
    v = [1.0, 1.0]
    assert {r.id for r in recall.retrieve(m, "what about dogs yesterday", v, NOW, 5).collect()} == {1}
    exact = recall.retrieve(m, '"dogs"', v, NOW, 5).collect()
    assert len(exact) <= 5 and recall.retrieve(m, "maybe cats", v, NOW, 3).first().id == 1
    got = recall.retrieve(m, "about cats please", v, NOW, 4)
    assert got.count() == 4 and got.columns == ["id", "score"]


def test_context(spark):
    m = store(spark)
    assert recall.context(m, "你好", [1.0, 1.0], NOW).count() == 0
    got = recall.context(m, "之前说的项目进度到哪一步了", [1.0, 1.0], NOW, tokens=60).collect()
    assert 0 < len(got) <= 5 and sum(len(r.text) for r in got) <= 90
    assert recall.context(m, "hello", [1.0, 1.0], NOW, force=True).count() > 0


def test_markdown(spark):
    text = "# About the project\n\n- **Name**: Memory Engine\n- **Password**: hunter2\n- a list item of some length\n- [link](x) is out\n- short\n\n角色：架构师\n"
    ents, rels = markdown.extracted(spark.createDataFrame([("a.md", text), ("b.md", text)], "filename string, content string"))
    names = {(e.name, e.type) for e in ents.collect()}
    assert {("About the project", "概念"), ("Memory Engine", "概念"), ("a list item of some length", "概念"), ("架构师", "人物")} <= names and not any("hunter2" in n for n, _ in names)
    assert {(r.source, r.relation, r.target) for r in rels.collect()} == {("a.md", "has_Name", "Memory Engine"), ("b.md", "has_Name", "Memory Engine")}


def test_upkeep(spark):
    kg = spark.createDataFrame([("a", "r", "b", 0.25), ("b", "r", "c", 0.1), ("x", "r", "c", 0.9)], "source string, relation string, target string, confidence double")
    new = spark.createDataFrame([("A", "r", "b", 0.2)], kg.schema)
    pairs = spark.createDataFrame([("a", "b", 3)], "a string, b string, n long")
    got = {(r.source, r.target): r.confidence for r in graph.self_update(kg, new, {"A": "a"}, pairs).collect()}
    assert got == {("a", "b"): 0.4, ("x", "c"): 0.9}
    fb = spark.createDataFrame([("x", "r", "c", False), ("n", "r", "m", True), ("a", "r", "b", True)], "source string, relation string, target string, correct boolean")
    got = {(r.source, r.target): r.confidence for r in graph.with_feedback(kg, fb).collect()}
    assert got == {("b", "c"): 0.1, ("n", "m"): 1.0, ("a", "b"): 1.0}
    types = lambda *n: spark.createDataFrame([(x, c, None, False) for x, c in n], "name string, category string, opposite string, transitive boolean")
    assert {(r.name, r.category) for r in graph.learned_types(types(("a", "old"), ("b", "old")), types(("a", "new"))).collect()} == {("a", "new"), ("b", "old")}


def test_profiles(spark):
    p = spark.createDataFrame([(1, (5.0, 4.0)), (2, (1.0, 2.0))], "product_id long, sales struct<monthly_sales:double,avg_rating:double>")
    s = spark.createDataFrame([(1, 9.0, None)], "product_id long, monthly_sales double, avg_rating double")
    got = {r.product_id: tuple(r.sales) for r in commerce.sold(p, s).collect()}
    assert got == {1: (9.0, 4.0), 2: (1.0, 2.0)}
    d = spark.range(1).select(commerce.newest(F.sequence(F.lit(1), F.lit(60))).alias("n"), commerce.capped_union(F.array(F.lit("b")), F.array(F.lit("a"), F.lit("b")), 5).alias("u")).first()
    assert d.n == list(range(11, 61)) and d.u == ["a", "b"]


def test_schedule():
    h = dt.timedelta(hours=1)
    assert schedule.due(NOW, None, None) == schedule.Due(True, False)
    assert schedule.due(NOW, NOW - h / 2, NOW - 7 * h) == schedule.Due(False, True)
    night = NOW.replace(hour=3)
    assert schedule.due(night, night - 2 * h, night - 2 * h) == schedule.Due(True, True)
