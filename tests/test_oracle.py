"""Every registered query equals its SQL twin."""

import pytest

import __spark_entry__
from workload import check, oracles, queries

QUERIES = queries.QUERIES
ORACLES = oracles.ORACLES
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.connect(SMALL)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, db, name):
    assert check.compare(QUERIES[name](spark, SMALL), db, ORACLES[name]) is None


# Queries with a join that is broadcast only after a size check.
CHECKED = [
    "broadcast_verdict",
    "context_cosine",
    "context_members",
    "context_pairs",
    "eligible_problems",
    "experiment_end_to_end",
    "load_generation_last_wins",
    "lookup_input",
    "prompts_full_problem",
    "prompts_only_solutions",
    "sample_contexts",
    "sample_contexts_cross",
    "variant_fallback",
    "verdict_codes",
]


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql_without_broadcast(spark, db, salted, name):
    assert check.compare(QUERIES[name](spark, SMALL), db, ORACLES[name]) is None


def test_entry(spark):
    result = __spark_entry__.entry(spark)
    assert result.columns == ["task_id", "n", "c", "k", "pass_at_k"]
    assert result.count() > 0
