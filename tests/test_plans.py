"""Physical plans: no query pairs rows through a cartesian product or a nested-loop join."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF0001

SLOW = {"q_route_mlp", "q_evaluate_all"}


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SLOW))
def test_no_pairwise_join(spark, name):
    df = E.queries()[name](spark, SF0001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan, name
    assert "BroadcastNestedLoopJoin" not in plan, name


def test_scan_prunes_columns(spark):
    df = E.queries()["q_token_count"](spark, SF0001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_scores_read_the_texts_once(spark):
    """Models and oracle come from one pass over the answers."""
    plan = E.queries()["q_eval_scores"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("regexp_extract_all") == 1
