"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries that are to give no row.
EMPTY = {"cond_eq_in_empty", "cond_range_null_bound"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, names, data):
    at = [columns.index(n) for n in names]
    return sorted((tuple("" if r[i] is None else f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in data))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert rows(got.columns, names, got.collect()) == rows(want.columns, names, want.fetchall())


def test_queries_give_rows():
    """On tables ten times as large, so that a condition that nothing meets doesn't pass for a right one."""
    larger = os.path.join(os.path.dirname(SF.rstrip("/")), "sf0.01")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{larger}/{t}.parquet'")
    assert {name for name, sql in queries.oracle_sql().items() if not con.sql(f"SELECT * FROM ({sql}) LIMIT 1").fetchall()} == EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
