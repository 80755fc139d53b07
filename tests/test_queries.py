"""Every registered query with SQL for the other engine gives its rows."""

import os

import duckdb
import pytest

from larkspur import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in q.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_same_rows(spark, duck, name):
    df = q.queries()[name](spark, SF)
    other = duck.sql(q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    at = [other.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)
    assert got == want


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(q.queries()) <= set(e.queries())
    assert set(q.oracle_sql()) <= set(e.oracle_sql())
    assert e.entry(spark).columns == ["l_returnflag", "l_linestatus", "n", "sum_qty"]
