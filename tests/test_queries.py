"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as registered
from checks.compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {n: q for n, q in registered.queries().items() if n not in registered.LLM_QUERIES}
SQL = {n: s for n, s in registered.oracle_sql().items() if n not in registered.LLM_SQL}


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, SF_DIR), connection, SQL[name]) is None


def test_entry_gives_the_known_pairs(spark):
    pairs = registered.entry(spark)
    assert (pairs.count(), pairs.select("output_concept").distinct().count()) == (365, 95)
