"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry_points
from strata.queries import load_all
from tests.oracle import compare, connect

QUERIES = load_all()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    assert compare(spark, duck, QUERIES[name], sf_dir) in (None, "EMPTY")


def test_entry_points(spark):
    df = entry_points.entry(spark)
    assert "total_revenue" in df.columns and df.count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
