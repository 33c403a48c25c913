"""Every registered query against its SQL answer, at the smallest scale."""

from pathlib import Path

import pytest
from check_oracles import compare, oracle_connection

import __spark_entry__ as contract
from pulsegrid.plans.event_oracles import ORACLES
from pulsegrid.plans.event_queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], SF) is None


def test_every_answer_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
