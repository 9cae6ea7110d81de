"""Registered queries against their SQL, and whole tables in their results."""

import pytest
from check import compare, connect

from threadlake.llm import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    ok, text = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert ok, text


def test_sql_is_text():
    assert "op3_records" not in ORACLES and all(isinstance(x, str) for x in ORACLES.values())


@pytest.mark.parametrize("name", ["op4_perplexity", "op10_toxicity"])
def test_every_document_is_there(spark, con, name):
    got = sorted(r[0] for r in QUERIES[name](spark, SF).select("doc_id").collect())
    assert got == [r[0] for r in con.sql("select doc_id from documents order by 1").fetchall()]


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_quality_ratio", "op8_secrets"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
