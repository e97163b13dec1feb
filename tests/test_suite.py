"""Every query of the suite against DuckDB."""

import pytest

from quillon import suite

from .conftest import DATA, same_as_duck

ORACLE = suite.oracle_sql()


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_query_matches_oracle(name, spark, duck):
    same_as_duck(suite.queries()[name](spark, DATA), duck, ORACLE[name])


@pytest.mark.parametrize("name", ["ne_all", "not_in_as_value", "all_ge", "not_any", "all_eq_null"])
def test_membership_takes_no_nested_loops(name, spark):
    plan = suite.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_many_ties_are_limited_before_one_task(spark):
    plan = suite.queries()["top_ties_many"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "LeftSemi" in plan
