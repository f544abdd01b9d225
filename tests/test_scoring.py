import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from evalweave.functions import passk
from evalweave.operators import report, scoring

# Verdict vectors of one task, n, c, pass@1, pass@2, sums per position, total.
CASES = [
    ([[1, 1], [1, 0], [-2]], 3, 1, 1 / 3, 2 / 3, [2, 1], 3 / 6),
    ([[0], [0]], 2, 0, 0.0, 0.0, [0], 0.0),
    ([[1, 1], [1, 1]], 2, 2, 1.0, 1.0, [2, 2], 1.0),
    ([[], [1]], 2, 2, 1.0, 1.0, [1], 1 / 2),
    ([[-1, -1, -1], [1, 1, 1]], 2, 1, 1 / 2, 1.0, [1, 1, 1], 3 / 6),
    ([[], []], 2, 2, 1.0, 1.0, [], 0.0),
]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(t, g, v) for t, case in enumerate(CASES) for g, v in enumerate(case[0])]
    return spark.createDataFrame(rows, "task_id bigint, gen_idx bigint, verdicts array<int>")


@pytest.fixture(scope="module")
def verdicts(vectors):
    return scoring.explode_results(vectors)


def test_vectors_score_like_rows(vectors, verdicts):
    def rows(df):
        return sorted(map(tuple, df.collect()))

    assert rows(scoring.vector_totals(vectors)) == rows(scoring.task_totals(verdicts))


def test_vectors_come_back(vectors, verdicts):
    assert sorted(map(tuple, scoring.collect_results(verdicts).collect())) == sorted(map(tuple, vectors.collect()))


def test_hand_written_scores(verdicts):
    totals = scoring.task_totals(verdicts)
    detail = scoring.pass_at_k_detail(totals, [1, 2, 3]).collect()
    assert {r.k for r in detail} == {1, 2}
    got = {(r.task_id, r.k): r.pass_at_k for r in detail}
    sums = {r.task_id: r.total for r in scoring.normalized_sum(totals).collect()}
    counts = {r.task_id: (r.n, r.c) for r in totals.collect()}
    positions = {}
    for r in scoring.tests_passed_by_position(verdicts).orderBy("test_idx").collect():
        positions.setdefault(r.task_id, []).append(r.n_passed)
    for task, (_, n, c, one, two, by_test, total) in enumerate(CASES):
        assert counts[task] == (n, c)
        assert got[task, 1] == pytest.approx(one, abs=1e-12)
        assert got[task, 2] == pytest.approx(two, abs=1e-12)
        assert sums[task] == pytest.approx(total)
        assert positions.get(task, []) == by_test


def test_mean_uses_the_same_k(verdicts):
    means = {r.k: r.pass_at_k for r in scoring.pass_at_k(scoring.task_totals(verdicts), [1, 2, 3]).collect()}
    assert means.keys() == {1, 2}
    assert means[1] == pytest.approx(sum(c[3] for c in CASES) / len(CASES))


def test_estimate_is_exact_and_monotone(spark):
    """Against binomials, and growing in c and k."""
    rows = [(n, c, k) for n in (1, 2, 7, 30, 200) for c in range(n + 1) for k in (1, 2, 5, 10, 100) if k <= n]
    df = spark.createDataFrame(rows, "n bigint, c bigint, k int")
    got = {
        (r.n, r.c, r.k): r.v
        for r in df.withColumn("v", passk.pass_at_k(F.col("n"), F.col("c"), F.col("k"))).collect()
    }
    for (n, c, k), value in got.items():
        want = 1 - Fraction(math.comb(n - c, k), math.comb(n, k))
        assert value == pytest.approx(float(want), abs=1e-12)
        if c < n:
            assert got[n, c + 1, k] >= value - 1e-12
        if (n, c, k + 1) in got:
            assert got[n, c, k + 1] >= value - 1e-12
    # The product over generations that the k-factor form stands for.
    for (n, c, k), value in got.items():
        if n - c >= k:
            missed = math.prod(1 - k / i for i in range(n - c + 1, n + 1))
            assert value == pytest.approx(1 - missed, abs=1e-12)


def test_billions_of_generations(spark):
    df = spark.range(1).select(
        passk.pass_at_k(F.lit(5_000_000_000), F.lit(50_000_000), F.lit(100)).alias("v")
    )
    assert df.first().v == pytest.approx(1 - 0.99**100, abs=1e-6)


def test_bad_k(verdicts):
    with pytest.raises(ValueError):
        scoring.pass_at_k(scoring.task_totals(verdicts), [0])


def test_histogram(verdicts):
    got = {r.status: r.n_tests for r in scoring.verdict_histogram(verdicts).collect()}
    assert got == {"passed": 11, "false": 3, "timeout": 3, "compile_error": 1}


def test_position_sums_add_up(verdicts):
    hits = scoring.task_totals(verdicts).agg(F.sum("hits")).first()[0]
    assert scoring.tests_passed_by_position(verdicts).agg(F.sum("n_passed")).first()[0] == hits


def test_context_delta(spark):
    results = spark.createDataFrame(
        [("g", "no_context", 1, 0.2, 0.1), ("g", "full_problem", 1, 0.5, 0.1), ("g", "full_problem", 2, 0.7, 0.3)],
        "grp string, context_type string, task_id bigint, pass_at_1 double, normalized_sum double",
    )
    row = report.context_delta(results).first()
    assert row.delta_full_problem_pass_at_1 == pytest.approx(0.4)
    assert row.delta_full_problem_normalized_sum == pytest.approx(0.1)
    assert row.delta_only_solutions_pass_at_1 is None


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_durations_with_any_timestamp(spark, kind):
    clock = spark.sql(
        f"""select * from values
        (1, 'parse', {kind} '2024-03-31 00:30:00'), (1, 'parse', {kind} '2024-03-31 00:30:01.25'),
        (1, 'judge', {kind} '2024-03-31 00:30:02'), (1, 'judge', {kind} '2024-04-02 00:30:02')
        as t(run_id, stage, ts)"""
    )
    got = {r.stage: r.seconds for r in report.stage_durations(clock).collect()}
    assert got == {"parse": 1.25, "judge": 172800.0, "total": 172802.0}


def test_run_log(spark):
    results = spark.createDataFrame(
        [("g", "no_context", 1, 0.2, 0.1), ("g", "full_problem", 1, 0.5, 0.1)],
        "grp string, context_type string, task_id bigint, pass_at_1 double, normalized_sum double",
    )
    durations = spark.createDataFrame([(1, "parsing", 2.5), (1, "total", 4.0)], "run_id bigint, stage string, seconds double")
    grid = spark.createDataFrame([("no_context", "g", 1, 0), ("full_problem", "g", 1, 7)], "context_type string, grp string, target_id bigint, run_index bigint")
    rows = report.run_log(results, durations, ["parsing", "evaluation", "total"], grid).collect()
    got = {r.run_name: (r.parsing_seconds, r.evaluation_seconds, r.total_seconds, r.run_index) for r in rows}
    assert got == {"1_no_context_g": (2.5, None, 4.0, 0), "1_full_problem_g": (2.5, None, 4.0, 7)}


def test_unknown_treatment_fails(spark):
    results = spark.createDataFrame(
        [("g", "other", 1, 1.0, 1.0)],
        "grp string, context_type string, task_id bigint, pass_at_1 double, normalized_sum double",
    )
    with pytest.raises(Exception, match="unknown treatment other"):
        report.context_delta(results).collect()
    row = report.context_delta(results, "other", ["other"]).first()
    assert row.other_pass_at_1 == 1.0
