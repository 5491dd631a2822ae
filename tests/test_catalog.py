"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from quillmesh.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (bool, type(None), str)):
        return x
    if isinstance(x, (int, decimal.Decimal)):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, con, name):
    mine, want = entry_point.queries()[name](spark, SF), con.sql(catalog.SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in mine.collect())
    expected = sorted(repr(tuple(map(plain, r))) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())
    assert got == expected


def test_every_entry_is_callable():
    queries = entry_point.queries()
    assert len(queries) > 100 and set(entry_point.oracle_sql()) <= set(queries)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
