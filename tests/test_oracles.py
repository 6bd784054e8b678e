"""Every query with SQL against DuckDB on the smallest tables; every other query runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stylemill.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_same_rows(name, spark, con):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()))
    result = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in result.description]
    want = sorted(repr(tuple(plain(dict(zip(names, x, strict=True))[c]) for c in cols)) for x in result.fetchall())
    assert sorted(names) == cols and rows == want


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_runs(name, spark):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
