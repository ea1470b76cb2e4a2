import pytest

import __spark_entry__ as entry

LAZY = [
    "persona_pairs", "criteria_grid", "few_shot_attach", "qa_alignment", "greedy_filter_lists", "diversity_rouge_names",
    "diversity_cosine", "rouge_l_pairs", "token_f1", "fed_score", "gpt_score", "g_eval", "embedding_match_f1",
    "mean_by_document", "first_k_per_file", "dialogue_prompts",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_single_task(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in plan


def test_rank_filter_is_a_group_limit(spark, sf):
    plan = entry.queries()["first_k_per_file"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # Twice by salt and twice by group: below the shuffle and above it.
    assert plan.count("WindowGroupLimit") == 4


def test_scans_read_needed_columns(spark, sf):
    plan = entry.queries()["persona_pairs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["source", "rows", "rouge", "cosine"]
    assert rows.count() == 20


def test_every_query_is_named(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
