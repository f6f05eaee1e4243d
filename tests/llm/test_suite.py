"""The registered queries: SQL where there is some, and the plans of the native ones."""

import pytest
from check import compare, connect

import __spark_entry__ as entry
from parcelrules.llm import suite

NATIVE = ("op7_kd_shards", "op8_divergence", "op10_url_filter")


@pytest.mark.parametrize("name", sorted(suite.CHECK_SQL))
def test_against_sql(name, spark, folder):
    assert compare(suite.QUERIES[name](spark, folder), connect(folder), suite.CHECK_SQL[name]) == ""


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_hold_no_python(name, spark, folder):
    plan = suite.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_one_query_per_operator():
    names = sorted(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
