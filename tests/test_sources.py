"""Readers, imports, and the stream against its batch version."""

import json
import zipfile

from pyspark.sql import functions as F

from memloom.operators import commerce
from memloom.sources import crm, graph_files, pages, session_tail, sessions
from memloom.streaming import ingest


def line(i, role, content, kind="message", ts=None):
    return json.dumps({"type": kind, "id": f"m{i}", "timestamp": ts or f"2024-01-01T00:00:{i:02d}.000Z", "message": {"role": role, "content": content}})


LONG = "This is a long enough message about the release plan number "


def write_logs(folder):
    a = [line(1, "user", [{"type": "text", "text": "Sender (untrusted metadata):\n```json\n{\"a\": 1}\n```\n[Wed 20260318 09:48 GMT+8] " + LONG + "one"}, {"type": "toolCall", "text": "zzz"}]), "", "{broken", line(2, "assistant", LONG + "two"), line(3, "system", "no"), line(4, "user", "x", kind="event"), line(5, "user", [{"type": "text", "text": "A new session was started now"}])]
    (folder / "aaa.jsonl").write_text("\n".join(a))
    (folder / "bbb.jsonl").write_text("\n".join([line(6, "user", LONG + "one"), line(7, "user", "好的"), line(8, "user", LONG + "three")]))
    (folder / "bbb.jsonl.reset.2024-01-02T00-00-00Z").write_text(line(9, "user", LONG + "four"))
    (folder / "ccc.jsonl.deleted.1").write_text(line(10, "user", LONG + "gone"))


def test_sessions(spark, tmp_path):
    write_logs(tmp_path)
    got = {(r.unique_id, r.id): r for r in sessions.read_sessions(spark, str(tmp_path)).collect()}
    assert set(got) == {("aaa", "m1"), ("aaa", "m2"), ("bbb", "m6"), ("bbb", "m7"), ("bbb", "m8"), ("bbb_reset_2024-01-02", "m9")}
    assert got["aaa", "m1"].content == LONG + "one" and got["bbb_reset_2024-01-02", "m9"].is_reset
    seen = spark.createDataFrame([("bbb", "2024-01-01T00:00:06.000Z")], "unique_id string, last_timestamp string")
    left = sessions.after(sessions.read_sessions(spark, str(tmp_path)), seen)
    assert {r.id for r in left.where("unique_id = 'bbb'").collect()} == {"m7", "m8"}
    assert sessions.newest_file(spark, str(tmp_path)).first().path.endswith(".jsonl")


def test_stream_equals_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write_logs(logs)
    batch = str(tmp_path / "batch")
    assert ingest.backfill(spark, str(logs), batch) == 4 and ingest.backfill(spark, str(logs), batch) == 0
    table, check = str(tmp_path / "stream"), str(tmp_path / "check")
    seen = []
    ingest.run(spark, str(logs), table, check, after=lambda df, k: seen.append(df.count())).awaitTermination()
    key = ["content", "summary", "importance", "quality"]
    rows = lambda p: sorted(map(tuple, spark.read.parquet(p).select(key).collect()))
    assert rows(table) == rows(batch) and sum(seen) == 6
    (logs / "ddd.jsonl").write_text("\n".join([line(20, "user", LONG + "five"), line(21, "user", LONG + "two")]))
    ingest.run(spark, str(logs), table, check).awaitTermination()
    assert spark.read.parquet(table).count() == 5


def test_flushes(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    (logs / "aaa.jsonl").write_text("\n".join(line(i, "user", LONG + str(i)) for i in range(4)))
    (logs / "bbb.jsonl").write_text(line(9, "user", LONG))
    q = ingest.flushes(session_tail.stream_sessions(spark, str(logs)), wait_ms=600_000).writeStream.format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("flushed").count():
                break
            q.awaitTermination(1)
        got = spark.table("flushed").collect()
    finally:
        q.stop()
    assert [(r.unique_id, r.n, r.last_id) for r in got] == [("aaa", 4, "m3")]


def test_enriched(spark):
    held = spark.createDataFrame([("a", "old", 0.5), ("b", "old", 0.5)], "id string, summary string, importance double")
    facts = spark.createDataFrame([("a", ["x", "y"], [0.4, 0.8]), ("b", [], [])], "id string, facts array<string>, importances array<double>")
    got = {r.id: (r.summary, round(r.importance, 6)) for r in ingest.enriched(held, facts).collect()}
    assert got == {"a": ("x; y", 0.6), "b": ("old", 0.5)}


def test_crm(spark, tmp_path):
    text = "customer_id,姓名,city,总消费,order_count\nu1,Ann,Rome,12.5,3\nu2,Bob,,oops,x\n,Cid,Oslo,1,1\n"
    (tmp_path / "a.csv").write_text(text)
    for rows in (crm.read_csv(spark, str(tmp_path / "a.csv")), crm.csv_text(spark, text)):
        ok, bad = crm.profiles(rows)
        got = {r.user_id: r for r in ok.collect()}
        assert got["u1"].basic.name == "Ann" and got["u1"].consumption.total_spent == 12.5 and got["u1"].consumption.total_orders == 3
        assert got["u2"].basic.region is None and got["u2"].consumption.total_spent is None and bad.count() == 1
    assert crm.walked({"a": {"b": [1, 2]}}, "a.b") == [1, 2] and crm.walked({"a": 1}, "x.y") == [] and crm.walked({"k": 1}, "") == [{"k": 1}]
    (tmp_path / "x.json").write_text(json.dumps({"data": {"rows": [{"id": 1}, {"id": 2}]}}))
    spark.dataSource.register(crm.ApiSource)
    api = spark.read.format("crm_api").option("urls", f"file://{tmp_path}/x.json").option("data_path", "data.rows").load()
    assert sorted(json.loads(r.value)["id"] for r in api.collect()) == [1, 2]


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "attrs": {"type": "t"}}], "edges": [{"source": "a", "target": "b", "attrs": {"relation": "r", "confidence": "0.5"}}]}, indent=1))
    nodes, edges = graph_files.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.first().type == "t" and edges.first().relation == "r" and edges.first().confidence == 0.5
    graph_files.write_graph(nodes, edges, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 1
    m = spark.createDataFrame([(1, "x")], "id long, content string")
    graph_files.export_agent(m, edges.drop("attrs"), str(tmp_path / "export"))
    held = spark.createDataFrame([(1, "mine"), (2, "y")], "id long, content string")
    assert {(r.id, r.content) for r in graph_files.import_agent(spark, str(tmp_path / "export"), held).collect()} == {(1, "mine"), (2, "y")}
    b = spark.createDataFrame([([("heading1", "T"), ("code", "x=1"), ("text", ""), ("text", "p")],)], "b array<struct<type:string,text:string>>")
    assert b.select(graph_files.block_markdown(F.col("b")).alias("m")).first().m == "## T\n\n```\nx=1\n```\n\np"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文内容".encode("gbk"))
    (tmp_path / "b.md").write_text("# Title\nsome **bold** [link](http://x)")
    (tmp_path / "c.html").write_text("<html><script>bad()</script><p>A &amp; B</p><p>C</p></html>")
    (tmp_path / "d.bin").write_bytes(b"\0")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>三</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "f.DOCX").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[1]: (r.content, r.refused) for r in pages.text_files(spark, str(tmp_path)).collect()}
    assert got == {
        "a.txt": ("中文内容", None), "b.md": ("Title\nsome bold link", None), "c.html": ("A & B\nC", None), "d.bin": (None, "no reader for .bin"), "e.docx": ("One two\n\n三", None), "f.DOCX": (None, "not readable"),
    }
    (tmp_path / "MEMORY.md").write_text("m")
    assert [r.filename for r in pages.workspace(spark, str(tmp_path)).collect()] == ["MEMORY.md", "b.md"]


def test_commerce(spark):
    edges = spark.createDataFrame([(1, "viewed"), (2, "kicked"), (3, None)], "id long, relation string")
    ok, bad = commerce.checked(edges, commerce.USER_PRODUCT)
    assert ([r.id for r in ok.collect()], sorted(r.id for r in bad.collect())) == ([1], [2, 3])


def test_active_session(spark, tmp_path):
    index = '{"agent:a:a": {"sessionId": "s1", "updatedAt": 2000, "sessionFile": "/a/old.jsonl"}, "agent:b:b": {"sessionId": "s2", "updatedAt": 10, "sessionFile": "/b/one.jsonl"}, "agent:c:c": {"sessionId": "s3", "updatedAt": 99, "sessionFile": "/c/gone.jsonl"}, "agent:d:d": {}}'
    (tmp_path / "sessions.json").write_text(index)
    rows = sessions.index_rows(spark, str(tmp_path / "sessions.json"))
    listed = [("a", "/a/old.jsonl", 5), ("a", "/a/new.jsonl", 1999), ("a", "/a/x.jsonl.deleted.1", 9999), ("b", "/b/one.jsonl", 5), ("b", "/b/two.jsonl", 11), ("c", "/c/here.jsonl", 7), ("e", "/e/only.jsonl", 1)]
    got = {r.agent: (r.source, r.path) for r in sessions.active_session(rows, spark.createDataFrame(listed, "agent string, path string, modified_ms long")).collect()}
    assert got == {"a": ("index", "/a/old.jsonl"), "b": ("newest", "/b/two.jsonl"), "c": ("newest", "/c/here.jsonl"), "d": ("none", None), "e": ("newest", "/e/only.jsonl")}
