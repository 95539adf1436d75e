"""Every registered query against its SQL on the smallest supplied tables."""

import pytest

import __spark_entry__ as entry
from checks.catalogue import QUERIES
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_registered_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
