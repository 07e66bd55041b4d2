"""Every query with an SQL equivalent, compared on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import compare, oracle
from checks.queries import ORACLES, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, SMALL)
    assert ok, note


def test_contract(spark):
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert all(isinstance(s, str) for s in entry_module.oracle_sql().values())
    assert entry_module.entry(spark).count() > 0


def test_feature_union(spark):
    rows = QUERIES["feature_union"](spark, SMALL).collect()
    assert {r["urgent"] for r in rows} <= {0, 1} and len({r["width"] for r in rows}) == 1
