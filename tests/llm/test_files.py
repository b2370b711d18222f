"""Quality rules, sharding and WARC against plain Python."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from memloom.llm import quality_rules, sharding, warc
from memloom.llm.common import scratch


def naive_repeat(words, k=8):
    seen = collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({i + j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(k)})


def test_repeat_words():
    r = random.Random(1)
    for _ in range(300):
        words = [r.choice("abc") for _ in range(r.randint(0, 60))]
        assert quality_rules.repeat_words(words) == naive_repeat(words)


def test_judge(spark):
    good = " ".join(f"word{i} text" for i in range(40))
    texts = [None, "", "a" * 100_000, good, "\n".join(["same line here now"] * 9 + [good]), good.replace(" ", "### "), good]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert [got[i].kept for i in range(7)] == [False, False, False, True, False, False, True]
    assert (got[4].n_dup_lines, got[3].n_words, got[3].base_failed) == (8, 80, False)
    assert quality_rules.judge(df.where("false")).count() == 0
    by = {r.doc_id: r.rejected_by for r in quality_rules.apply_cascade(df).collect()}
    assert {i for i, x in by.items() if x is None} == {3, 6} and by[5] == "symbols"


def test_judge_of_null_ids_and_clashing_columns(spark):
    good = " ".join(f"word{i} text" for i in range(40))
    df = spark.createDataFrame([(None, good, "a"), (None, "x", "b"), (None, good, "a")], "doc_id long, text string, rejected_by string")
    assert sorted((r.doc_id is None, r.kept) for r in quality_rules.judge(df).collect()) == [(True, False), (True, True), (True, True)]
    got = quality_rules.apply_cascade(df, to="verdict").collect()
    assert sorted((r.rejected_by, r.verdict) for r in got if r.verdict is None) == [("a", None)] * 2 and len(got) == 3


def test_cascade_order():
    slow = quality_rules.Rule("slow", lambda x: sum(range(20_000)) > 0 and len(x.text) < 2)
    fast = quality_rules.Rule("fast", lambda x: len(x.text) < 2)
    assert [m.rule.name for m in quality_rules.plan_cascade(["", "ab", "c"] * 10, (slow, fast))] == ["fast", "slow"]


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_sharding(spark, n):
    data = [(i if i % 7 else None, None if i % 11 == 0 else f"text {i % 50} " * (i % 9), i) for i in range(n)]
    df = spark.createDataFrame(data, "doc_id long, text string, shard int")
    got = sharding.shard_documents(df, 16, bucket_bytes=3000).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((a, b) for a, b, _ in data), key=repr)
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(16)), default=0) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_op7_digests(spark):
    import duckdb

    from memloom.llm.queries import op7_sharding

    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()}
    got = op7_sharding(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == want and {r.grown_shard for r in got} == {None}
    places = sorted((r.shard, r.slot) for r in got)
    counts = collections.Counter(s for s, _ in places)
    assert places == [(s, k) for s in range(16) for k in range(counts[s])] and max(counts.values()) - min(counts.values()) <= 1


def pages(spark, data):
    return spark.createDataFrame([(*x, 1) for x in data], "page_id long, url string, html string, payload_bytes int")


def test_warc(spark):
    long, odd = "x" * 100, "é" * 60
    data = [(3, "http://a/%0A\n", long), (1, None, long), (9, "u", long), (2, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (None, "u", long), (6, "u", odd), (7, "u", odd), (8, "u", "\r\n\r\nWARC/1.1"), (1, None, long), (-5, "u", "z" * 300_000)]
    folder = scratch(spark, "t")
    manifest = warc.write_warc(pages(spark, data), folder, roll=300, range_bytes=50_000)
    got = warc.read_warc(manifest).collect()
    first = {}
    for i, _, h in data:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, u, h in data:
        f = first.get(h) if i is not None and i > first.get(h, i) else None
        want.append((i, u, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "response" if f is None else "revisit", f))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    again = warc.write_warc(pages(spark, data), scratch(spark, "t"), roll=300, range_bytes=50_000)
    names = lambda m: sorted((r.path.rsplit("/", 1)[1], r.crc32) for r in m.collect())
    assert names(manifest) == names(again) and len(names(again)) > 2
    assert warc.archive_pages(pages(spark, data).where("false")).count() == 0


def _rows(df):
    return sorted((r.shard, r.slot, r.doc_id, r.text) for r in df.collect())


def test_a_seed_fixes_the_order(spark):
    """The order is the same at any number of partitions, another one by another seed, and no sorted one."""
    data = [(i, f"text {i} " * (i % 7)) for i in range(3000)]
    shard = lambda n, seed=1: _rows(sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(n), 4, bucket_bytes=20_000, seed=seed))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = shard(3)
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert shard(5) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    ids = [x[2] for x in got]
    assert shard(3, 2) != got and sorted(ids) == list(range(3000))
    assert 0.3 < sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / 3000 < 0.7
    apart = sum(abs(a - b) < 30 for a, b in zip(ids, ids[1:], strict=False))
    assert apart < 150  # neighbours of the table are neighbours no more


def test_repeated_rows_part(spark):
    """A third of the table is one row, another third has no id and no text."""
    data = [(i, f"text {i} " * 5) for i in range(1000)] + [(5000, "again " * 10)] * 1000 + [(None, None)] * 1000
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, slot int").repartition(4)
    got = sharding.shard_documents(df, 8, bucket_bytes=10_000).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(data, key=repr)
    buckets = sharding.scattered(df.select("doc_id", "text"), 20).where("doc_id = 5000").groupBy("bucket").count().collect()
    assert len(buckets) == 20 and max(r["count"] for r in buckets) < 100
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1


def test_ids_far_apart(spark):
    """Most ids close together, a few at the ends of their type: the ranges still follow the bytes."""
    ids = [-(2**63), 2**63 - 1, 0, *range(10**15, 10**15 + 400), None, None]
    data = [(i, "u", f"page {i} " * 200) for i in ids]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    cuts = warc.cuts(df, 100_000)
    assert cuts == sorted(set(cuts)) and len(cuts) > 4 and sum(10**15 <= c < 10**15 + 400 for c in cuts) > 4
    for x in (-(2**63), 5, 10**15 + 77, 2**63 - 1):
        assert spark.range(1).select(warc._upto(F.lit(x).cast("long"), cuts)).first()[0] == sum(c <= x for c in cuts)
    manifest = warc.write_warc(df, scratch(spark, "warc"), range_bytes=100_000)
    assert manifest.count() == len(cuts) + 1
    assert sorted((r.page_id for r in warc.read_warc(manifest).collect()), key=repr) == sorted(ids, key=repr)
    assert warc.cuts(df.where("page_id IS NULL"), 10) == [] == warc.cuts(df.where("false"), 10)


def test_letters_are_those_of_sql(spark):
    """Numbers that aren't digits, and marks, are no letters; the query's SQL agrees."""
    import duckdb

    from memloom.llm.queries import _OP6_SQL

    odd = "² ½ Ⅷ ٣ é 漢 ª ʰ ا ̈ _ 7 一 ㊀ 𝒜 ⅻ".split(" ")
    texts = [" ".join([c * 2] * 30) for c in odd] + [" ".join(f"{c}{k}" for k in range(40)) for c in odd] + [None, ""]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(rows)])
    df = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(rows)], "doc_id long, text string, kept string")
    want = sorted(con.execute(_OP6_SQL).fetchall())
    assert sorted(map(tuple, quality_rules.judge(df).collect())) == want
    assert [r.doc_id for r in quality_rules.judge(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).collect()] == [None]
