"""Every engine query against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from tidemill import queries as core

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in core.TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, DIR)
    got = duck.sql(core.oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows(df.columns, df.collect()) == rows(got.columns, got.fetchall())
