"""Every panel query with SQL gives DuckDB's rows on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from vintara import queries as panel

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, (Decimal, float)) else str(x)


def test_tables_are_there():
    assert all(Path(f"{SF}/{t}.parquet").exists() for t in TABLES)


@pytest.mark.parametrize("name", sorted(panel.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = panel.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(panel.ORACLE_SQL[name])
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    left = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(panel.QUERIES) - set(panel.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert panel.QUERIES[name](spark, SF).count() > 0
