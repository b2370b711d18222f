"""Writers, growing session files, listeners, fact merges, and extraction in steps."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from memloom.operators import models, shared, stores
from memloom.plans import intent
from memloom.sources import session_tail
from memloom.streaming import events, ingest


def said(i, text, role="user"):
    return json.dumps({"type": "message", "id": f"m{i}", "timestamp": f"2024-01-01T00:00:{i:02}Z", "message": {"role": role, "content": text + " with some more words to keep"}}) + "\n"


def test_growing_files(spark, tmp_path):
    """Each run gets just what was appended: whole lines only, replaced files anew."""
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.jsonl", logs / "b.jsonl"
    a.write_text(said(1, "one") + said(2, "two")[:30])
    seen = []

    def run():
        seen.clear()
        w = session_tail.stream_sessions(spark, str(logs)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        w.foreachBatch(lambda df, k: seen.extend(r.id for r in df.collect())).start().awaitTermination()
        return sorted(seen)

    assert run() == ["m1"]
    a.write_text(said(1, "one") + said(2, "two") + said(3, "three").rstrip("\n"))
    b.write_text(said(4, "four"))
    assert run() == ["m2", "m3", "m4"]
    with a.open("a") as f:
        f.write("\n" + said(5, "five"))
    assert run() == ["m5"]
    assert run() == []
    b.write_text(said(6, "6"))
    b.write_text("")
    assert run() == []


def test_appended_messages_become_memories(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text(said(1, "the first message"))
    table, check = str(tmp_path / "t"), str(tmp_path / "c")
    known, calls = events.Events(), []
    known.on("new_message", lambda df, k: calls.append(df.count()))
    known.on("new_message", lambda df, k: 1 / 0)
    ingest.run(spark, str(logs), table, check, after=known.after).awaitTermination()
    with (logs / "a.jsonl").open("a") as f:
        f.write(said(2, "the second message") + said(3, "the first message"))  # its text is held already
    ingest.run(spark, str(logs), table, check, after=known.after).awaitTermination()
    assert spark.read.parquet(table).count() == 2 and calls == [1, 2]
    assert [n for n, _ in known.failed] == ["new_message"] * 2


def test_ranges_of_lines(tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_bytes(b'{"a": 1}\n' + b"x" * 200_000)
    r = session_tail.TailReader(str(tmp_path))
    assert list(json.loads(r.latestOffset()["files"]).values()) == [9]
    p.write_bytes(b"x" * 200_000)
    assert list(json.loads(r.latestOffset()["files"]).values()) == [0]


def test_model_ranges():
    now = dt.datetime(2024, 3, 10, 12)
    assert intent.told_range('so: {"start_date": "2024-03-01", "end_date": "2024-03-02"}', now)[0] == dt.datetime(2024, 3, 1)
    for bad in (None, "", "{", '{"start_date": 5, "end_date": 6}', '{"start_date": "2024-03-02", "end_date": "2024-03-01"}'):
        assert intent.told_range(bad, now)[0] == dt.datetime(2024, 3, 3)


def test_facts(spark):
    facts = lambda *x: spark.createDataFrame([(1, f) for f in x], "owner long, fact string")
    held, new = facts("likes green tea", "lives in Rome", "has a cat"), facts("likes green tea", "plays chess")
    told = spark.createDataFrame([(1, "lives in Rome", "UPDATE", "lives in Milan"), (1, "has a cat", "DELETE", None)], "owner long, fact string, event string, text string")
    got = {(r.fact, r.event) for r in models.merged_facts(held, new, told).collect()}
    assert got == {("likes green tea", "NONE"), ("lives in Milan", "UPDATE"), ("has a cat", "DELETE"), ("plays chess", "ADD")}
    assert {(r.fact, r.event) for r in models.merged_facts(held, new).collect()} == {("likes green tea", "NONE"), ("lives in Rome", "NONE"), ("has a cat", "NONE"), ("plays chess", "ADD")}
    assert models.merged_facts(held.where("false"), new.where("false")).count() == 0


def test_extraction_in_steps(spark):
    df = spark.createDataFrame([(1, "We moved Redis to Docker. Then it runs with Kafka."), (2, ""), (3, None)], "id long, text string")
    rows = {r.id: r for r in models.in_steps(df, "text").collect()}
    pairs = {(r.source, r.target) for r in rows[1].relations}
    assert pairs == {("Docker", "Redis")}
    held = spark.createDataFrame([("Redis", "runs_on", "Docker")], "source string, relation string, target string")
    e, r = models.incremental(models.in_steps(df.where("id = 1"), "text", name=lambda a, b, t: F.lit("runs_on")), held)
    assert {x.name for x in e.collect()} >= {"Kafka"} and not {"Redis", "Docker"} & {x.name for x in e.collect()}
    assert ("Docker", "Redis") in {(x.source, x.target) for x in r.collect()}


def test_one_bad_row_keeps_the_others(spark):
    def make():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return [[1.0]] * len(texts)

        return embed

    got = {r.id: r.embedding for r in models.embedded(spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id long, t string").coalesce(1), "t", make).collect()}
    assert got == {1: [1.0], 2: None, 3: [1.0]}


def test_imports(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, content string")
    held, new = rows((1, "a"), (2, None)), rows((1, "b"), (5, "c"), (4, "c"), (6, "a"), (7, None), (8, ""))
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(stores.imported(held, new).where("content IS NOT NULL")) == [(1, "a"), (4, "c")]
    assert got(stores.imported(held, new, "overwrite")) == [(1, "b"), (4, "c"), (6, "a")]
    assert stores.imported(held, new.where("false")).count() == 2
    with pytest.raises(ValueError):
        stores.imported(held, new, "both")


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared.shared_dir(Session())
