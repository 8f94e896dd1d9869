"""Every registered query against its SQL, over the whole smallest tables."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables are not here")
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
ROW_ORDER = ["running_total_user", "prior_event", "asof_purchase", "nearest_balance", "percentile_functions", "event_runs", "run_breaks", "allocate_tax"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}") + 0.0
    return value.isoformat() if isinstance(value, dt.datetime) else value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


def check(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    found = frame.collect()
    if name not in ORACLES:
        assert found
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows(frame.columns, found) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    check(spark, duck, name)


@pytest.mark.parametrize("name", ROW_ORDER)
def test_query_with_cut_groups(spark, duck, hot, name):
    hot(7)
    check(spark, duck, name)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_only_known_queries_have_sql():
    assert set(ORACLES) <= set(QUERIES)
