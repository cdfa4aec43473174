"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from rosterlake.plans import list_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    if name in queries.ORACLE_SQL:
        wanted = tables.sql(queries.ORACLE_SQL[name])
        assert rows(got.columns, data) == rows(wanted.columns, wanted.fetchall())
    else:
        assert data


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    known = entry.queries()
    assert set(queries.QUERIES) <= set(known) and set(entry.oracle_sql()) <= set(known)
