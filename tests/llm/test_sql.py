"""The numbered queries against their SQL, and all of them for whole results, over the smallest tables."""

import duckdb
import pytest

from verdure.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: (r[names.index("doc_id")], r[0])
    want = sorted(cur.fetchall(), key=key)
    rows = sorted((tuple(r) for r in got.select(*names).collect()), key=key)
    assert len(rows) == len(want)
    for r, w in zip(rows, want):
        for a, b in zip(r, w):
            assert a == b or isinstance(a, float) and abs(a - b) <= 2e-6, (names, r, w)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op13_ranked_search"}))
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert QUERIES[name](spark, SF).count() == docs.count()
