"""Every registered query against its SQL over the smallest driver tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from lexiloom.plans import catalogue
from lexiloom.plans.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, (float, Decimal)):
        return "null" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in value) + "]"
    return "null" if value is None else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_its_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert found.columns
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert _rows(found.columns, rows) == _rows(columns, want.fetchall())


def test_entry_is_a_query_with_rows(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns and found.count() > 0


def test_sql_is_of_registered_queries_only():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
