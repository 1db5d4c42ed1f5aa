"""Every query against its SQL, at the smallest size."""

from __future__ import annotations

import glob
import os

import pytest

from plumbline import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(names, table):
    order = sorted(names)
    return sorted(str([r[names.index(n)] for n in order]) for r in table)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    got = catalog.queries()[name](spark, sf_dir)
    found = [tuple(r) for r in got.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, found) == rows(want.columns, want.fetchall())
