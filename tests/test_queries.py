"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, queries()[name], oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 5 and all(r["total_months"] == 400 and r["avg_persistence"] > 0 for r in rows)
