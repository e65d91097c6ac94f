"""Every query runs on the smallest tables and agrees with its SQL twin, where it has one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelforge import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
FAST = [n for n in core.QUERIES if n in core.ORACLES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def key(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 5) if isinstance(value, (int, float)) else str(value)


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(key(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    want = duck.sql(core.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = canon(df.columns, [tuple(r) for r in df.collect()]), canon(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(y)), (name, a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(core.ORACLES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_model_query(spark):
    out = core.QUERIES["forecast_counts"](spark, DATA)
    assert out.where("prediction < 0").count() == 0
