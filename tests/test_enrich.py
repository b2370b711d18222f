"""Enrichment as a stream with retries against the same over a table; profile builders against plain Python."""

import os
import time

import pytest

from memloom.operators import builders
from memloom.streaming import enrich


def small(texts):
    return [[float(len(t))] for t in texts]


def recovering(path):
    """A model that fails on some texts until a file is there."""

    def make():
        def model(text):
            if "broken" in text or ("flaky" in text and not os.path.exists(path)):
                raise RuntimeError("no answer")
            return enrich.core_facts(text)

        return model

    return make


TEXTS = [("a", "First fact. Second fact 7! First fact"), ("b", "a flaky text. more"), ("c", ""), ("d", "broken for good"), ("e", None), ("f", " . ! "), ("g", "one. two. three. four. five. six")]


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def until(found, want, query, seconds=90):
    end = time.time() + seconds
    while time.time() < end and found() < want:
        assert query.exception() is None
        time.sleep(0.5)
    return found()


def test_stream_retries_and_restarts(spark, rocks, tmp_path):
    flag, schema = f"{tmp_path}/up", "id string, content string"
    make = recovering(flag)
    spark.createDataFrame(TEXTS, schema).coalesce(1).write.json(f"{tmp_path}/in/one")

    def start():
        s = enrich.stream(spark.readStream.schema(schema).json(f"{tmp_path}/in/*"), make, lambda: small, retries=30, wait_ms=1)
        return s.writeStream.format("memory").queryName("updates").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="500 milliseconds").start()

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = start()
        assert until(lambda: spark.table("updates").count(), 2, q) == 2  # a and g; b waits
        first = {r.id: r for r in spark.table("updates").collect()}
        q.stop()
        open(flag, "w").close()
        spark.createDataFrame([("h", "later text")], schema).coalesce(1).write.json(f"{tmp_path}/in/two")
        out = enrich.stream(spark.readStream.schema(schema).json(f"{tmp_path}/in/*"), make, lambda: small, retries=30, wait_ms=1)
        seen = {}

        def keep(df, _):
            seen.update({r.id: r for r in df.collect()})

        q = out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="500 milliseconds").foreachBatch(keep).start()
        assert until(lambda: len(seen), 2, q) == 2  # b, whose wait was kept, and h
        q.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    both = {k: r.asDict() for k, r in (first | seen).items()}
    rows = spark.createDataFrame([*TEXTS, ("h", "later text")], schema)
    assert both == {r.id: r.asDict() for r in enrich.over(rows, make, lambda: small).collect()}
    assert set(both) == {"a", "b", "g", "h"} and both["g"]["keywords"] == both["g"]["facts"][:6]


def test_failures_leave_memories_alone(spark, tmp_path):
    held = spark.createDataFrame([(i, t, "old", 0.1) for i, t in TEXTS], "id string, content string, summary string, importance double")
    new = enrich.over(held, recovering(f"{tmp_path}/never"), lambda: small)
    got = {r.id: (r.summary, r.importance) for r in enrich.merged(held, new).collect()}
    assert got == {"a": ("First fact; Second fact 7", 0.55), "g": ("one; two; three", 0.5)} | {k: ("old", 0.1) for k in "bcdef"}
    rules = {r.id: r.summary for r in enrich.by_rules(held).collect()}
    assert rules["a"] == "First fact; Second fact 7" and "c" not in rules and "f" not in rules


def test_profiles_are_built_field_by_field(spark):
    answers = [("u1", 1, '{"region": "north", "tags": ["x"], "shopping_habits": ["late"]}'), ("u1", 2, 'Sure: ```json\n{"region": "", "gender": "f", "tags": ["y", "z"]}\n```'), ("u1", 3, "no idea"), ("u2", 1, None), ("u2", 2, '{"shopping_habits": ["early"], "unknown": 1}')]
    df = spark.createDataFrame(answers, "user string, turn int, answer string")
    new = builders.updates(df, "user", builders.USER_FIELDS, builders.F.col("turn"), builders.F.concat("user", builders.F.col("turn")))
    held = spark.createDataFrame([("u1", "basic", "region", ["south"], "import"), ("u1", "basic", "age_range", ["30"], "import"), ("u1", "insights", "shopping_habits", ["often"], "import")], "user string, grp string, field string, value array<string>, source string")
    got = {(r.user, r.field): (r.value, r.source) for r in builders.built(held, new, "user").collect()}
    assert got == {
        ("u1", "region"): (["north"], "u11"), ("u1", "age_range"): (["30"], "import"), ("u1", "gender"): (["f"], "u12"), ("u1", "tags"): (["y", "z"], "u12"),
        ("u1", "shopping_habits"): (["late", "often"], "u11"), ("u2", "shopping_habits"): (["early"], "u22"),
    }


def test_model_slot_survives_failures(spark):
    def make():
        return lambda t: {"ok": '{"brand": "b"}'}[t]

    df = spark.createDataFrame([(1, "ok"), (2, "fails"), (3, None)], "product int, text string")
    told = builders.answered(df, "text", make)
    assert {r.product: r.answer for r in told.collect()} == {1: '{"brand": "b"}', 2: None, 3: None}
    new = builders.updates(told, "product", builders.PRODUCT_FIELDS, builders.F.lit(0), builders.F.lit("info"))
    assert [(r.product, r.field, r.value) for r in new.collect()] == [(1, "brand", ["b"])]
