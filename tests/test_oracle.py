"""Every registered query against its SQL on the second engine."""

import pytest
from folders import SMALL
from oracle import connect, difference, rows_of_duckdb, rows_of_spark

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, duck, name):
    rows = rows_of_spark(entry.queries()[name](spark, SMALL))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows[1]
    else:
        assert difference(rows, rows_of_duckdb(duck, sql)) is None


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "trace_id" in frame.columns
