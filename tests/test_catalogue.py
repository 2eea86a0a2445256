"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalogue, stored  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name in catalogue.SQL:
        want = sql.sql(catalogue.SQL[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted(want.columns) == columns
        assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    else:
        assert got


def test_sql_covers_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_sketch_is_kept_once_and_not_for_every_key(spark):
    plan = stored.unique_keys_estimate_bound(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    sketches = [line for line in plan.split("\n") if "approx_count_distinct" in line and "Aggregate" in line]
    assert sketches and all("keys=[]" in line for line in sketches)
