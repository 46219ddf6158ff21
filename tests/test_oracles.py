"""Every catalogued query against its DuckDB oracle on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillet.plans import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}" if math.isfinite(value) else str(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in ORACLES:
        found = tables.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
