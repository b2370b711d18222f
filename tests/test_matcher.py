"""Entities with places against the rules as expressions and as patterns."""

import re

from memloom.functions import entities as ent
from memloom.operators import matcher

TEXTS = [
    "张三在北京用 Python 做了订单系统, OpenAI 和 openai. Alice Smith met Bob at Google",
    "字节跳动科技 in 上海, github GitHub, 李四说 Docker Compose 很好; The Redis",
    None, "", "   ", "R", "ÀPython éGo 字Ünïted", "Ann Lee Ann Ann Lee", "x" * 5000 + " MySQL",
]


def test_names_are_those_of_the_expressions(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "id long, content string, name int")
    got = {}
    for r in matcher.entities(df).collect():
        assert TEXTS[r.id][r.start : r.end].lower() == r.name.lower() and r.n >= 1
        got.setdefault(r.id, set()).add((r.type, r.name))
    for r in df.where("content IS NOT NULL").select("id", ent.extracted("content").alias("e")).collect():
        assert got.get(r.id, set()) == {(x.type, x.name) for x in r.e}, TEXTS[r.id]


def test_counts_and_first_places(spark):
    df = spark.createDataFrame([("a", "go Go gogo, Ann Lee and Ann")], "key string, text string")
    got = {(r.type, r.name): (r.start, r.end, r.n) for r in matcher.entities(df, "key", "text").collect()}
    assert got["technology", "Go"] == (0, 2, 4) and got["person", "Ann Lee"] == (12, 19, 1) and got["person", "Ann"] == (24, 27, 1)


def test_every_span_of_the_tagger(spark):
    text = "腾讯公司和百度公司, 订单系统用 Java 与 Python, 在浙江省; JavaScript"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, content string")
    got = sorted((r.start, r.end, r.type, r.name) for r in matcher.spans(df).collect())
    want = sorted((m.start(), m.end(), kind, m[1]) for kind, p in matcher.TAGGER for m in re.finditer(p, text) if len(m[1]) > 1)
    assert got == want and any(x[2] == "地点" for x in got) and {r.confidence for r in matcher.spans(df).collect()} == {0.7}
