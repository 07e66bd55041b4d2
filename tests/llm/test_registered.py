"""The registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import oracle, rows_of
from sparkdesk.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    cur = oracle(SMALL).execute(ORACLES[name]())
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, df.collect()) == want


def test_entry_has_all():
    queries = entry_module.queries()
    assert {"pipeline", *QUERIES} <= set(queries)
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(entry_module.oracle_sql())
