"""Each registered query against its SQL on DuckDB, over the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from verdure.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("VERDURE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(SF) / t}.parquet')")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9))
    return a == b


def key(row):
    return tuple((v is None, round(v, 2) if isinstance(v, float) else v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    inexact = {n for n, t in got.dtypes if t == "double"}
    columns = sorted(got.columns, key=lambda c: (c in inexact, c))  # exact columns lead the order of rows
    cur = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(columns)
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=key)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert len(rows) == len(want)
    for r, w in zip(rows, want):
        assert all(same(a, b) for a, b in zip(r, w)), (columns, r, w)


#: Queries without SQL: what their rows must hold.
def balanced(rows):
    return sum(r["recall"] for r in rows) / len(rows)


CLAIMS = {
    "model_forest": lambda rows: balanced(rows) > 0.9,
    "model_boosting": lambda rows: balanced(rows) > 0.9,
    "model_logistic": lambda rows: balanced(rows) > 0.8,
    "model_svm": lambda rows: balanced(rows) > 0.5,
    "model_bayes": lambda rows: balanced(rows) > 0.8,
    "stacked_models": lambda rows: balanced(rows) > 0.9,
    "parameter_search": lambda rows: rows[0]["balanced_accuracy"] > 0.8,
    "random_parameter_search": lambda rows: rows[0]["balanced_accuracy"] > 0.8,
    "saved_model": lambda rows: rows and all(r["predicted"] == r["again"] for r in rows),
    "forest_importances": lambda rows: abs(sum(r["importance"] for r in rows) - 1) < 1e-6 and rows[0]["feature"] == "b1",
    "forest_class_map": lambda rows: len(rows) == 1000 and {r["class_id"] for r in rows} <= {-9999.0, 0.0, 1.0, 2.0},
    "batch_image_features": lambda rows: len(rows) == 1 and all(v is not None for v in rows[0]),
    "geodesic_metres": lambda rows: rows and all(0 <= r["metres"] < 20_004_000 for r in rows if r["metres"] is not None),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_holds_its_claim(spark, name):
    assert CLAIMS[name](QUERIES[name](spark, SF).collect())
