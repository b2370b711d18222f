"""Plans that the oracle doesn't reach: time anchors, intents, decisions, Chinese text rules, chunks, compression."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from memloom.functions import decay
from memloom.functions import entities as ent
from memloom.functions import text as fn
from memloom.operators import chunker, compress, dedup, filters, fusion, graph, models, profile, metric_join
from memloom.plans import intent

NOW = dt.datetime(2024, 1, 31, 15, 30, 45)  # a Wednesday
D = lambda d, h=0, m=0, s=0, month=1, year=2024: dt.datetime(year, month, d, h, m, s)


@pytest.mark.parametrize(
    ("question", "lo", "hi", "kind", "grain"),
    [
        ("今天讨论了什么", D(31), NOW, "range", "day"),
        ("what did we say yesterday?", D(30), D(30, 23, 59, 59), "point", "day"),
        ("the day before yesterday", D(29), D(29, 23, 59, 59), "point", "day"),
        ("前天的会议", D(29), D(29, 23, 59, 59), "point", "day"),
        ("30分钟前", D(31, 15, 0), D(31, 15, 1), "point", "minute"),
        ("2 hours ago", D(31, 13), D(31, 14), "point", "hour"),
        ("3天前", D(28), D(28, 23, 59, 59), "point", "day"),
        ("2 weeks ago", D(17), D(18), "point", "week"),
        ("1个月前", D(1), D(1, 23, 59, 59), "point", "month"),
        ("half an hour ago", D(31, 15, 0), D(31, 15, 1), "point", "minute"),
        ("半天前", D(31, 3), D(31, 4), "point", "hour"),
        ("half a year ago", D(4, month=8, year=2023), D(4, 23, 59, 59, month=8, year=2023), "point", "month"),
        ("刚才", NOW - dt.timedelta(hours=1), NOW, "range", "hour"),
        ("recently", D(24), NOW, "range", "day"),
        ("last week", D(22), D(29), "range", "week"),
        ("这周", D(29), NOW, "range", "week"),
        ("上个月", D(1, month=12, year=2023), D(1), "range", "month"),
        ("last year", D(1, year=2023), D(1), "range", "year"),
        ("今年", D(1), NOW, "range", "year"),
        ("what is it", None, None, None, None),
    ],
)
def test_time_anchor(question, lo, hi, kind, grain):
    a = intent.time_anchor(question, NOW)
    assert (a.lo, a.hi, a.kind, a.grain, a.reference) == (lo, hi, kind, grain, lo)


def test_cleaned():
    assert intent.cleaned("昨天讨论的项目") == "讨论的项目"
    assert intent.cleaned("notes from last week?") == "notes"
    assert intent.cleaned("the plan 2 days ago") == "the plan"


def test_intents(spark):
    q = ['"exact words"', "give me the precise text", "what about yesterday", "maybe something like this", "hello there"]
    got = [intent.recognise(x, NOW) for x in q]
    assert [(g.intent, g.mode, g.confidence) for g in got] == [("exact", "bm25", 0.9), ("exact", "bm25", 0.8), ("time", "time", 0.85), ("fuzzy", "vector", 0.7), ("general", "hybrid", 0.5)]
    df = spark.createDataFrame([(x,) for x in [*q, None]], "q string")
    rows = intent.intents(df, "q", NOW).collect()
    assert [r.intent for r in rows] == ["exact", "exact", "time", "fuzzy", "general", "general"] and rows[2].lo == D(30)


def test_decide(spark):
    assert not intent.decide("你好，谁在那里").should_recall and not intent.decide("hello").should_recall
    d = intent.decide("上次我们讨论的项目进度是什么，和谁合作？")
    assert (d.level, d.memory_limit, d.compression, d.entity_limit) == ("summary", 5, 0.4, 5)
    assert intent.decide("之前呢").memory_limit == 3
    assert intent.decide("之前的方案哪里不好？？谁提出来的呢").memory_limit == 7
    rows = intent.decisions(spark.createDataFrame([("上次做到哪了啊我想知晓",), (None,)], "q string"), "q").collect()
    assert [r.should_recall for r in rows] == [True, False]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


def test_chinese_text(spark):
    assert one(spark, "张三在北京用Python", lambda x: ent.people(x))[0] == "张三"
    assert "北京" in one(spark, "张三在北京", ent.places)
    assert one(spark, "他在腾讯工作", ent.organisations) == ["腾讯"]
    assert one(spark, "记忆系统很好", ent.projects) == ["记忆"]
    for name, kind in (("李雷", "人物"), ("某某研究院", "组织"), ("记忆管理系统", "项目"), ("Redis", "技术"), ("iPhone", "产品"), ("浙江省某某市", "地点"), ("abc", "概念")):
        assert one(spark, name, ent.infer_type) == kind, name
    assert [one(spark, x, ent.valid_entity) for x in ("今天", "3个", "用户", "x", "12", "张三")] == [False] * 5 + [True]
    assert one(spark, "好的。", lambda x: fn.quality(x, F.lit("user"))) == 0.1
    assert one(spark, "好的，我马上去处理这个问题吧", lambda x: fn.quality(x, F.lit("user"))) == 0.2
    assert one(spark, "2024年1月5日项目决定采用新方案，因为增长了30%", lambda x: fn.quality(x, F.lit("user"))) == 0.85
    assert one(spark, "这个系统使用Redis，版本 7.0，基于Linux", profile.kind) == "fact"
    assert one(spark, "我曾经学习并解决过这个，遇到很多", profile.kind) == "experience"
    assert one(spark, "我们开发了用户功能", lambda x: fn.topics(x)) == ["开发", "产品"]
    assert one(spark, "决定采用3个版本", fn.importance) == 0.95


def test_lenient_json(spark):
    f = lambda x: fn.lenient_json(x, "k bigint").getField("k")
    for t, k in (('{"k": 3}', 3), ('a\n```json\n{"k": 4}\n```', 4), ('so {"k": 5} yes', 5), ("none", None), ("{broken", None), (None, None)):
        assert one(spark, t, f) == k


def test_compress(spark):
    assert one(spark, "今天开会。张三负责项目，很好。", lambda x: compress.core_fact(x)) == "张三负责项目"
    assert one(spark, "第一句。第二句。第一句。第三句", lambda x: compress.facts(x, 2)) == "第一句 | 第二句"
    assert one(spark, "一" * 8 + "。" + "二" * 10, lambda x: compress.truncate(x, 10)) == "一" * 8 + "。"
    assert one(spark, "一二。" + "三" * 20, lambda x: compress.truncate(x, 10)) == "一二。" + "三" * 7 + "..."
    assert one(spark, "x" * 10, lambda x: compress.compress(x, 1.0)) == "x" * 10
    page = spark.createDataFrame([(1, "a" * 50), (2, "b" * 90), (3, "c" * 70), (4, "d")], "id long, t string")
    got = compress.budget(page, 120, F.col("id"), F.col("t"), F.substring("t", 1, 40)).collect()
    assert [(r.id, len(r.text), r.total) for r in got] == [(1, 50, 50), (2, 40, 90)]


def test_chunks():
    assert list(chunker.chunks("")) == [] and list(chunker.chunks("  ")) == [] and list(chunker.chunks("short")) == ["short"]
    text = "。" + "字" * 3000
    got = list(chunker.chunks(text))
    assert len(got) == 7 and all(len(c) <= 500 for c in got)
    text = " ".join(f"Sentence number {i} is here." for i in range(300))
    got = list(chunker.chunks(text))
    at = 0
    for c in got:  # every character is covered, in order
        found = text.index(c)
        assert found <= at + 1
        at = found + len(c)
    assert at == len(text)


def test_filter_tree(spark):
    df = spark.createDataFrame([(1, 0, False, ["a"], ("x",)), (2, 1, True, ["b", "c"], ("y",))], "id long, n int, flag boolean, tags array<string>, s struct<k:string>")
    ids = lambda node: [r.id for r in filters.filtered(df, node).collect()]
    assert ids({"operator": "Equal", "path": ["n"], "valueNumber": 0}) == [1]
    assert ids({"operator": "Equal", "path": ["flag"], "valueBoolean": False}) == [1]
    assert ids({"operator": "Equal", "path": ["tags"], "valueString": "c"}) == [2]
    assert ids({"operator": "ContainsAny", "path": ["tags"], "valueStringArray": ["a", "c"]}) == [1, 2]
    assert ids({"operator": "Or", "operands": [{"operator": "Equal", "path": ["n"], "valueNumber": 1}, {"operator": "Huh"}]}) == [2]
    assert ids({"operator": "Huh"}) == [1, 2]


def test_decay(spark):
    got = spark.createDataFrame([(x,) for x in ("2024-01-01T00:00:00Z", "2024-01-01 00:00:00", "2024-01-01", "2024-01-01T00:00:00.5", "nonsense", None)], "x string").select(decay.parsed(F.col("x")).alias("t")).collect()
    assert [g.t is not None for g in got] == [True] * 4 + [False] * 2
    w = spark.createDataFrame([(0.5,), (5.0,), (10.0,), (50.0,)], "d double").select(decay.boost(F.col("d")).alias("b")).collect()
    assert w[0].b == 1.2 and w[1].b > w[2].b > w[3].b


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    x = {r.id: r.score for r in fusion.reciprocal_rank({"a": a, "b": b}).collect()}
    y = {r.id: r.score for r in fusion.reciprocal_rank({"b": b, "a": a}).collect()}
    assert x == y and max(x, key=x.get) == 2


def test_graph(spark):
    kg = spark.createDataFrame([("a", "in", "b", 1.0), ("b", "in", "c", 0.5), ("c", "in", "d", 0.9), ("a", "x", "c", 0.1), ("d", "in", "a", 0.3)], "source string, relation string, target string, confidence double")
    assert {(r.name, r.distance) for r in graph.k_hop(kg, "a", 2, directed=True).collect()} == {("b", 1), ("c", 1), ("d", 2)}
    assert [r.path for r in graph.shortest_paths(kg, "a", "d", 3, directed=True).collect()] == [["a", "c", "d"]]
    new = graph.infer(kg, ["in"])
    assert {(r.source, r.target, r.confidence) for r in new.collect()} == {("b", "d", 0.4), ("c", "a", 0.24), ("d", "b", 0.24)}
    both = kg.unionByName(new)
    again = graph.infer(both.unionByName(graph.infer(both, ["in"])), ["in"])
    assert again.count() == 0


def test_similar_pairs_in_tiles(spark, monkeypatch):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(60, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, [0.0] * 4), (98, None)], "id long, embedding array<double>")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(n[i] @ n[j]), 6) >= 0.8}
    monkeypatch.setattr(metric_join, "TILE", 7)
    assert {(r.a, r.b) for r in dedup.similar_pairs(df, 0.8).collect()} == want
    dropped = dedup.keep_first(dedup.similar_pairs(df, 0.8))
    assert {r.dropped for r in dropped.collect()} == {j for _, j in want}


def test_models(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, "hello world"), (3, None)], "id long, t string")
    got = [r.embedding for r in models.embedded(df, "t").orderBy("id").collect()]
    assert got[0] == got[1] and got[2] is None and abs(sum(x * x for x in got[0]) - 1) < 1e-6

    def broken():
        def f(texts):
            raise RuntimeError

        return f

    assert [r.embedding for r in models.embedded(df, "t", broken).collect()] == [None] * 3
    x = models.checked(models.extracted(spark.createDataFrame([(1, "Alice uses Docker on Linux")], "id long, t string"), "t"), "t").first()
    assert {e.name for e in x.entities} >= {"Docker", "Linux", "Alice"}
    new = spark.createDataFrame([("u", "likes green tea a lot"), ("u", "has a cat")], "owner string, fact string")
    held = spark.createDataFrame([("u", "likes green tea a lot"), ("v", "has a cat")], "owner string, fact string")
    assert {(r.fact, r.event) for r in models.new_facts(new, held).collect()} == {("likes green tea a lot", "NONE"), ("has a cat", "ADD")}
    assert one(spark, "/x/y.JPG", models.file_kind) == "image" and one(spark, "/x/y", models.file_kind) == "other"
    assert one(spark, "短文本", models.route) == "small" and one(spark, "因为下雨", models.route) == "large"
