"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.oracle import compare, connect
from trencher.plans import load_queries
from trencher.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
load_queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    found = compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER)
    assert found["ok"], found["why"]


@pytest.mark.parametrize("name", ["ingredient_estimates", "alcohol_refinements"])
def test_plan_stays_small(spark, name):
    assert len(QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()) < 100_000
