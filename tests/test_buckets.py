"""Partial changes of bucketed tables: what they give, and which files they leave alone."""

import glob

import pytest

from memloom.operators.buckets import BucketTable


def files(path):
    return {f for f in glob.glob(f"{path}/rows/_bucket=*/*.parquet")}


def rows(t):
    return sorted(map(tuple, t.rows().collect()), key=repr)


@pytest.fixture()
def made(spark, tmp_path):
    data = [(f"d{k % 40}", k, f"text {k}") for k in range(200)] + [(None, 900, "no key")]
    df = spark.createDataFrame(data, "doc string, chunk int, content string").repartition(4)
    return BucketTable.create(df, f"file://{tmp_path}/t", "doc", 16), data, f"{tmp_path}/t"


def test_delete_leaves_other_files(spark, made):
    t, data, path = made
    before = files(path)
    n = t.delete(spark.createDataFrame([("d3",), ("absent",)], "doc string"))
    assert n == 1 and rows(t) == sorted((x for x in data if x[0] != "d3"), key=repr)
    assert len(before - files(path)) <= 1 and len(before & files(path)) >= len(before) - 1
    kept = files(path)
    assert t.delete(spark.createDataFrame([("absent",)], "doc string")) == 0 and files(path) == kept
    t.delete(spark.createDataFrame([(None,)], "doc string"))
    assert all(x[0] is not None for x in rows(t))


def test_replace_and_patch(spark, made):
    t, data, path = made
    new = spark.createDataFrame([("d5", 0, "fresh"), ("new", 1, "added"), (None, 2, "null key")], "doc string, chunk int, content string")
    t.replace(new)
    want = [x for x in data if x[0] not in ("d5", None)] + [("d5", 0, "fresh"), ("new", 1, "added"), (None, 2, "null key")]
    assert rows(t) == sorted(want, key=repr)
    before = files(path)
    assert t.patch(spark.createDataFrame([("d7", "patched"), ("absent", "x")], "doc string, content string")) == 1
    assert rows(t) == sorted(((a, b, "patched") if a == "d7" else (a, b, c) for a, b, c in want), key=repr)
    assert len(before & files(path)) >= len(before) - 1
    assert sorted(r.chunk for r in t.get("d7", "new").collect()) == sorted([x[1] for x in want if x[0] in ("d7", "new")])


def test_emptied_buckets_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    t = BucketTable.create(df, f"file://{tmp_path}/t", "k", 64)
    t.delete(df.where("k = 'a'").select("k"))
    assert rows(t) == [("b", 2)] and len(files(f"{tmp_path}/t")) == 1
    t.delete(df.select("k"))
    assert rows(t) == []
    e = BucketTable.create(df.where("false"), f"file://{tmp_path}/e", "k", 4)
    assert rows(e) == [] and e.delete(df.select("k")) == 0
    e.replace(df)
    assert rows(e) == [("a", 1), ("b", 2)]
