"""Every registered query against its SQL counterpart, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from parity import connect, differences
from wordspace.plans.queries import QUERIES
from wordspace.plans.sql import oracles

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
SQL = oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(SQL) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert not differences(entry.queries()[name](spark, SF_DIR), con, SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 250
