"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lexigraft import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[t] for c, t in df.dtypes} == types
    rows = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    places = [want.columns.index(c) for c in columns]
    assert rows == sorted(str(tuple(r[i] for i in places)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(e.queries())
