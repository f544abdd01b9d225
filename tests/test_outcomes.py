"""Results as bitmaps beside the rules of one attempt, test and generation at a time."""

import itertools
import random

import pytest

from evalweave.operators import judging, outcomes, report, scoring
from evalweave.plans import experiment
from tests.test_judging import ATTEMPTS, RESOLVED

GENERATIONS = "task_id bigint, gen_idx bigint, compiled boolean"
TESTS = "task_id bigint, n_tests int, test_type string"
CODES = {"passed": 1, "false": 0, "timeout": -1}


def status(attempts):
    """The status of a test from its recorded attempts, in order."""
    if attempts and attempts[0][1]:
        return "timeout"
    if attempts and attempts[0][2]:
        return "runtime_error"
    last = None
    for code, late, unstarted, out in attempts:
        if late or unstarted:
            continue
        if code == 0:
            return "passed" if (out or "").strip() == "7" else "false"
        last = code
    return None if last is None else f"returncode:{last}"


def plain(generations, recorded, tests):
    """Verdicts by generation: ``recorded[(task, gen)][variant][test]`` is a list of attempts."""
    out = {}
    for task, gen in {(t, g) for t, g, _ in generations} | set(recorded):
        compiled = {(t, g): c for t, g, c in generations}.get((task, gen))
        by_variant = {
            v: {i: status(a) for i, a in found.items()} for v, found in recorded.get((task, gen), {}).items()
        }
        first = by_variant.get(1, {})
        failed = all(s == "returncode:1" for s in first.values() if s is not None)
        chosen = by_variant[2] if failed and by_variant.get(2) else first
        n_tests, kind = tests.get(task, (1, None))
        if compiled is False:
            out[task, gen] = {0: -2}
        elif not chosen:
            out[task, gen] = {i: -1 for i in range(max(n_tests, 1))}
        else:
            out[task, gen] = {i: CODES.get(s, -3) for i, s in chosen.items()}
            if kind == "call_based" and list(chosen) == [0]:
                out[task, gen] = {i: out[task, gen][0] for i in range(max(n_tests, 1))}
    return out


def made(seed=11):
    rng = random.Random(seed)
    kinds = [(0, False, False, "7"), (0, False, False, "8"), (0, False, False, None), (1, False, False, ""),
             (1, False, False, ""), (2, False, False, ""), (None, True, False, None), (None, False, True, None)]
    generations, recorded, tests = [], {}, {}
    for task in range(1, 25):
        n = rng.choice([1, 1, 3, 63, 64, 65, 130, 200])
        tests[task] = (n, rng.choice(["call_based", "standard_input"]))
        for gen in range(4):
            if rng.random() < 0.85:
                generations.append((task, gen, rng.random() < 0.8))
            some = rng.choice([kinds, kinds[3:5], kinds[:1]])
            found = {}
            for variant in rng.choice([(), (1,), (1, 2), (2,)]):
                only = rng.choice([range(n), range(1), [n - 1]])
                found[variant] = {i: [rng.choice(some) for _ in range(rng.randint(1, 3))] for i in only}
            if found:
                recorded[task, gen] = found
    tests.pop(24)
    return generations, recorded, tests


@pytest.fixture(scope="module")
def tables(spark):
    generations, recorded, tests = made()
    rows = [
        (task, gen, variant, test, number, *attempt, "7")
        for (task, gen), found in recorded.items()
        for variant, by_test in found.items()
        for test, attempts in by_test.items()
        for number, attempt in enumerate(attempts, 1)
    ]
    random.Random(1).shuffle(rows)
    return (
        spark.createDataFrame(generations, GENERATIONS),
        spark.createDataFrame(rows, ATTEMPTS).repartition(3),
        spark.createDataFrame([(t, n, k) for t, (n, k) in tests.items()], TESTS),
    )


def by_generation(verdicts):
    out = {}
    for r in verdicts.collect():
        found = out.setdefault((r.task_id, r.gen_idx), {})
        assert r.test_idx not in found
        found[r.test_idx] = r.verdict
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_the_rules(tables, broadcast, request):
    if not broadcast:
        request.getfixturevalue("salted")
    assert by_generation(experiment.judge(*tables)) == plain(*made())


def test_every_order_of_attempts(spark):
    rows = [
        (1, 1, 1, test, number, *attempt, "7")
        for test, (attempts, _) in enumerate(RESOLVED.values())
        for number, attempt in enumerate(attempts, 1)
    ]
    generations = spark.createDataFrame([(1, 1, True)], GENERATIONS)
    tests = spark.createDataFrame([(1, len(RESOLVED), "standard_input")], TESTS)
    got = by_generation(experiment.judge(generations, spark.createDataFrame(rows, ATTEMPTS), tests))[1, 1]
    assert [got[i] for i in range(len(RESOLVED))] == [CODES.get(want, -3) for _, want in RESOLVED.values()]


def test_scores_equal_those_of_the_verdicts(tables):
    rows = experiment.judged(*tables)
    verdicts = experiment.judge(*tables)
    for got, want in (
        (outcomes.generation_scores(rows), scoring.generation_correct(verdicts)),
        (outcomes.task_totals(rows), scoring.task_totals(verdicts)),
    ):
        assert got.columns == want.columns
        # A vector's length counts from its last test, also if one before it is missing.
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_two_exchanges_from_attempts_to_totals(tables):
    generations, attempts, tests = tables
    plain_attempts = attempts.sparkSession.createDataFrame(attempts.collect(), attempts.schema)
    rows = outcomes.settled(outcomes.by_generation(generations, plain_attempts), tests)
    assert exchanges(rows) == 1
    assert exchanges(outcomes.task_totals(rows)) == 2


def test_dealt_attempts_stay_where_they_are(tables):
    """Attempts dealt by generation are combined before the one exchange, with the same results."""
    generations, attempts, tests = tables
    dealt = attempts.repartition(3, "gen_idx")
    rows = outcomes.by_generation(generations, dealt, "strict", dealt=True)
    assert exchanges(rows) == 2
    assert by_generation(outcomes.verdicts(outcomes.settled(rows, tests))) == plain(*made())


@pytest.mark.parametrize("hot", [100_000, 2])
def test_tests_are_copied_for_hot_tasks_only(tables, spark, salted, monkeypatch, hot):
    """Beyond the broadcast bound, too, a row of tests is not copied for every salt."""
    from evalweave.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(skew, "salts", lambda *_: 2 if hot == 2 else pytest.fail("copied for salts"))
    assert by_generation(experiment.judge(*tables)) == plain(*made())
    test_problems_bring_their_tests(spark)


def test_no_rows(spark, tables):
    empty = [spark.createDataFrame([], t.schema) for t in tables]
    assert experiment.judge(*empty).count() == 0
    assert outcomes.task_totals(experiment.judged(*empty)).count() == 0


def test_runs_are_evaluated_apart(spark):
    """One generation of a task under three treatments, right in one."""
    run = [(t, "g", 1, 1, 0, int(t == "full_problem")) for t in ("no_context", "full_problem", "only_solutions")]
    verdicts = spark.createDataFrame(
        run, "context_type string, grp string, task_id bigint, gen_idx bigint, test_idx int, verdict int"
    )
    metrics = experiment.evaluate(verdicts, [1, 10], report.RUN_IN_GROUP)
    want = {"no_context": 0.0, "full_problem": 1.0, "only_solutions": 0.0}
    assert {r.context_type: (r.n, r.c) for r in metrics.detail.collect()} == {t: (1, int(s)) for t, s in want.items()}
    for rows in (metrics.detail, metrics.pass_at_k):
        assert {r.context_type: r.pass_at_k for r in rows.collect()} == want
    assert {r.context_type: r.total for r in metrics.normalized_sum.collect()} == want
    assert {r.context_type: r.n_passed for r in metrics.by_position.collect()} == want


def test_each_group_of_runs_has_its_own_ks(spark):
    """A k counts where every task of the same group and treatment has enough generations."""
    rows = [
        (t, "g", task, gen, 0, 1)
        for (t, n), task in itertools.product((("no_context", 2), ("full_problem", 12)), (1, 2))
        for gen in range(n)
    ]
    verdicts = spark.createDataFrame(
        rows, "context_type string, grp string, task_id bigint, gen_idx bigint, test_idx int, verdict int"
    )
    metrics = experiment.evaluate(verdicts, [1, 10], report.RUN_IN_GROUP)
    assert sorted((r.context_type, r.k) for r in metrics.pass_at_k.collect()) == [
        ("full_problem", 1), ("full_problem", 10), ("no_context", 1)
    ]
    assert sorted((r.context_type, r.task_id, r.k) for r in metrics.detail.collect()) == [
        *(("full_problem", t, k) for t in (1, 2) for k in (1, 10)), ("no_context", 1, 1), ("no_context", 2, 1)
    ]


def test_problems_bring_their_tests(spark):
    samples = spark.createDataFrame(
        [(1, '{"inputs": ["a", ["b", "c"]], "outputs": ["7", ["8", "9"]]}'),
         (2, '{"inputs": [[1], [2], [3]], "outputs": [{"1": 2}, 4, 5], "fn_name": "f"}'), (3, "{")],
        "id bigint, input_output string",
    )
    attempts = [(1, 1, 0, "7"), (1, 1, 1, "8\n9"), (1, 2, 0, "8"), (2, 1, 0, '{"1": 2.0}'), (2, 2, 0, "x"), (3, 1, 0, "7")]
    rows = [(t, g, 1, i, 1, 0, False, False, out) for t, g, i, out in attempts]
    generations = spark.createDataFrame(
        [*((t, g, True) for t, g, *_ in attempts), (2, 3, True), (1, 9, False)], GENERATIONS
    ).distinct()
    recorded = spark.createDataFrame(rows, ATTEMPTS.removesuffix(", expected string"))
    got = by_generation(outcomes.verdicts(experiment.judge_problems(samples, generations, recorded)))
    assert got == {
        (1, 1): {0: 1, 1: 1}, (1, 2): {0: 0}, (1, 9): {0: -2},
        (2, 1): {0: 1, 1: 1, 2: 1}, (2, 2): {0: 0, 1: 0, 2: 0}, (2, 3): {0: -1, 1: -1, 2: -1}, (3, 1): {0: 0},
    }
    assert judging.tests_per_task(judging.test_cases(samples)).count() == 2
