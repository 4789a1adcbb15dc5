"""Every named query against its SQL twin on the smallest tables."""

import re
from pathlib import Path

import pytest

from check import connect, difference
from panelcast.plans.catalog import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert difference(name, df, con) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        # an unpartitioned window lists its ordering first
        assert not re.search(r"windowspecdefinition\([^,()]* (ASC|DESC)", line), line


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_delegates(spark):
    import __spark_entry__ as contract

    queries = contract.queries()
    assert QUERIES.items() <= queries.items()  # those of the optional operators may follow
    assert all(re.match(r"pipeline$|op\d+_", name) for name in queries.keys() - QUERIES.keys())
    assert set(contract.oracle_sql()) <= set(queries)
    assert contract.entry(spark).count() > 0
