"""Every registered query with SQL agrees with it on whole tables; the others give rows."""

import datetime
import math

import duckdb
import pytest

from tidemark.plans import catalog
from tidemark.plans.roles import TABLES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert rows
        return
    found = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    order = [found.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).limit(1).count() == 1
