"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from sievelake.plans import registry
from tests.oracle import ROOT, connection, difference

FOLDER = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_query(spark, con, key):
    queries, oracles = registry.queries(), registry.oracle_sql()
    assert difference(spark, con, queries[key], oracles[key], FOLDER) is None


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["name", "rank", "id", "dist"]
