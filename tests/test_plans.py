"""Physical plans: no cross joins, no row-at-a-time Python, pushed filters, pruned columns, limited windows."""

import re

import pytest

from rankweave.operators import retrieval
from rankweave.plans import bindings as b
from rankweave.plans.registry import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(REGISTRY))
def test_no_cross_join_and_no_row_udf(spark, name):
    plan = plan_of(REGISTRY[name].plan(spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan, f"{node} in the plan of {name}"
    assert "MapInArrow" not in plan and "MapInPandas" not in plan


def test_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(b.model_concepts(spark, SF_DIR))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(value,250", plan)
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    index = spark.createDataFrame([("m", "d", "x", 1.0)], "model string, disease string, CUI string, bm25 double")
    queries = spark.createDataFrame([("p", "1", "x")], "dataset string, patient_id string, CUI string")
    assert "WindowGroupLimit" in plan_of(retrieval.bm25_match(queries, index))


def test_best_row_per_key_is_an_aggregate(spark):
    assert "Window" not in plan_of(REGISTRY["top1_by_score"].plan(spark, SF_DIR))
    assert "Window" not in plan_of(REGISTRY["weekly_dedupe"].plan(spark, SF_DIR))


def test_weekly_dedupe_combines_before_the_shuffle(spark):
    plan = plan_of(REGISTRY["weekly_dedupe"].plan(spark, SF_DIR))
    assert "partial_max_by" in plan
