"""Every query of the driver contract against its SQL twin."""

import pytest

import __spark_entry__ as contract
import compare
from vecprune.plans.catalog import QUERIES
from vecprune.plans.oracle import ORACLE

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 431


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert compare.differences(df, con, contract.oracle_sql()[name]) == []
