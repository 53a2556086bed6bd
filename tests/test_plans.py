"""What the physical plans must and must not hold."""

import re

import pytest

from __spark_entry__ import entry, queries
from tallywork.plans import catalog

SF = "/root/testdata/sf0.001"
PYTHON = {"code_check_report", "valid_prefix_table", "rewrite_decision", "custom_rewards"}
WRITES = {
    "scan_problems", "scan_training_set", "publish_questions", "write_generation_logs", "archive_run_logs",
    "pair_right_wrong_all", "scored_groups", "results_by_method", "group_advantage", "throttled_checks",
}
BATCH = sorted(n for n in catalog.QUERIES if not n.endswith("_stream") and n not in WRITES)


def plan(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_product_and_python_only_where_needed(spark, name):
    text = plan(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)
    assert bool(re.search(r"MapInPandas|MapInArrow|EvalPython", text)) == (name in PYTHON)


def test_votes_aggregate_before_the_shuffle(spark):
    text = plan(spark, "majority_answer")
    assert text.count("partial_count(1)") == 1 and text.count("partial_max") == 1 and "collect_list" not in text


def test_rank_limit_reaches_below_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "vote_frequencies") and "Partial" in plan(spark, "vote_frequencies")


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan(spark, "majority_answer")
    assert "ReadSchema: struct<doc_id:bigint>" in plan(spark, "budget_schedule")


def test_joins_have_another_way_than_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("attach_correct_answer", "fill_eventual_answer", "rewrite_decision", "predict_table"):
            assert "SortMergeJoin" in plan(spark, name), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_query_has_a_check(spark):
    assert set(catalog.QUERIES) == set(catalog.ORACLES) <= set(queries())
    assert entry(spark).columns == ["question_id", "answer"]
