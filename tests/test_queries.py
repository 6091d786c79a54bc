"""Registered queries against the same results in SQL."""

import os

import pytest

from flowsift.plans.catalog import ORACLES, QUERIES

from .oracle import compare, duck

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
# windows of half an hour hold too few flows at the smallest scale
EMPTY = {"active_windows", "entity_features", "labelled_scores"} if SF.endswith("sf0.001") else set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    said = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert said is None or (said == "no rows" and name in EMPTY)
