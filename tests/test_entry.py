"""Every query with SQL gives the rows that DuckDB computes, over the whole tables of the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def comparable(rows):
    cell = lambda x: None if x is None else round(float(x), 5) if isinstance(x, float) and math.isfinite(x) else str(x)
    return sorted(repr([cell(x) for x in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    assert comparable(df.select(*columns).collect()) == comparable(result.fetchall())
