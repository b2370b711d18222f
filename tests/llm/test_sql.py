"""The queries of this subpackage that have SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from memloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_sql_of_odd_rows(spark, tmp_path):
    """Nulls, empty and short texts, copies, a chain of links, and runs that meet end to end."""
    a = "the quick brown fox jumps over the lazy dog and runs far away from here, éé " * 3
    words = [f"w{k}" for k in range(60)]
    texts = [None, "", "  ", "One two", "one  TWO", a, a + " tail", "x" + a, a, "z" * 130, "z" * 49, *(" ".join(words[k : k + 40]) for k in (0, 2, 4, 30))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op8_jaccard_join", "op9_suffix_dedup"):
        want = con.execute(queries.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        got = queries.queries()[name](spark, str(tmp_path)).select(columns).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
