"""Every registered query against its SQL at the smallest scale, and its plan."""

import re

import pytest
from check import compare, connect

from threadlake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    ok, text = compare(df, con, ORACLES[name])
    assert ok, text


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns[0] == "query_id" and df.count() > 0
