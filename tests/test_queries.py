"""Every registered query against its SQL counterpart, over whole tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference


@pytest.fixture(scope="module")
def database(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(entry.ORACLES) == set(entry.QUERIES)


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_same_as_sql(spark, database, sf_dir, name):
    assert difference(spark, database, name, sf_dir) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
