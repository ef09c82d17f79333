"""Every registered query against its oracle, and the shape of the contract."""

import pytest

import __spark_entry__ as contract
from conftest import SF
from oracle import compare, connect
from tallymark.catalog import all_queries

ORACLE = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_of_the_library_has_an_oracle():
    assert set(all_queries()) <= set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, db, name):
    assert compare(QUERIES[name](spark, SF), db, ORACLE[name]) is None
