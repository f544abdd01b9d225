"""What the physical plans must and must not contain."""

import re

import pytest

from workload import fixtures as fx
from workload import queries

QUERIES = queries.QUERIES
SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Sizes of the sorted partitions, one row each, are added up in one place to number rows.
OFFSETS = re.compile(r"[^\n]*SinglePartition, ENSURE[^\n]*\n(?=[^\n]*HashAggregate\(keys=\[_part#)")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products_and_no_python(spark, name):
    plan = OFFSETS.sub("", _plan(QUERIES[name](spark, SMALL)))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "SinglePartition, ENSURE"):
        if bad.startswith("SinglePartition") and name in ONE_ROW:
            continue
        assert bad not in plan, name


# Aggregates over all rows into one, and the offsets of sorted partitions.
ONE_ROW = {
    "n_eligible_tags",
    "n_tags_sketch",
    "pass_at_k_detail",
    "pass_at_k_detail_orders",
    "run_grid",
    "run_grid_by_difficulty",
    "generation_requests",
}


@pytest.mark.parametrize("name", ["sample_targets", "sample_contexts", "context_cosine"])
def test_groups_are_limited_before_the_shuffle(spark, name):
    assert _plan(QUERIES[name](spark, SMALL)).count("WindowGroupLimit") >= 2


def test_large_tables_are_not_broadcast(spark, salted):
    plan = _plan(QUERIES["sample_contexts"](spark, "/root/testdata/sf0.01"))
    assert "BroadcastHashJoin" not in plan and "_salt" in plan


def test_only_needed_columns_are_read(spark):
    scores = _plan(QUERIES["pass_at_k"](spark, SMALL))
    assert "props" not in scores and "value" not in scores.split("Location")[0].split("FileScan")[-1]
    targets = _plan(QUERIES["sample_targets"](spark, SMALL))
    assert "p_name" not in targets
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,MEDIUM)" in targets


@pytest.mark.parametrize("name", ["resolve_attempts", "variant_fallback", "test_cases", "quarantined_samples"])
def test_lines_are_dealt_once(spark, name):
    """Lines are numbered, joined and judged in one dealing by order, in tasks whose share does not grow."""
    lines = _plan(fx.line_tests(spark, SMALL))
    assert lines.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in lines and "rangepartitioning" not in lines
    if name != "quarantined_samples":
        plan = _plan(QUERIES[name](spark, SMALL))
        assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
