"""Joins of the stage table with what comes from it take its buckets: tokens are not dealt again."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["align_coord", "align_line_order", "align_fuzzy_token", "section_propagate"])
def test_tokens_are_not_shuffled_again(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "docweave_resume_tokens" in plan and "Exchange hashpartitioning" not in plan
