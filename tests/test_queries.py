"""Every registered query against its reference SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from findlake.plans import all_queries, all_sql
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, con, name):
    status, _, _, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert status in ("ok", "rows-only") and not note, note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


def test_entry_has_every_query():
    assert set(all_queries()) <= set(entry.queries()) and set(all_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())
