import json

import pytest

from evalweave.operators import generations, judging, report
from evalweave.plans import experiment

ATTEMPTS = (
    "task_id bigint, gen_idx bigint, variant int, test_idx int, attempt int, exit_code int,"
    " timed_out boolean, launch_error boolean, stdout string, expected string"
)
# name -> attempts (exit_code, timed_out, launch_error, stdout), expected status; expected output is "7"
RESOLVED = {
    "passes at once": ([(0, False, False, "7\n")], "passed"),
    "wrong at once": ([(0, False, False, "8")], "false"),
    "first timeout is final": ([(None, True, False, None), (0, False, False, "7")], "timeout"),
    "launch error is final": ([(None, False, True, None), (0, False, False, "7")], "runtime_error"),
    "second attempt counts": ([(1, False, False, ""), (0, False, False, "7"), (0, False, False, "8")], "passed"),
    "second wrong, third unused": ([(1, False, False, ""), (0, False, False, "8"), (0, False, False, "7")], "false"),
    "second timeout goes on": ([(1, False, False, ""), (None, True, False, None), (0, False, False, "7")], "passed"),
    "last code is reported": ([(1, False, False, ""), (2, False, False, ""), (3, False, False, "")], "returncode:3"),
    "code of the last finished": ([(1, False, False, ""), (2, False, False, ""), (None, True, False, None)], "returncode:2"),
}


@pytest.fixture(scope="module")
def resolved(spark):
    rows = [
        (1, 1, 1, test, number, *attempt, "7")
        for test, (attempts, _) in enumerate(RESOLVED.values())
        for number, attempt in enumerate(attempts, 1)
    ]
    return judging.resolve_attempts(spark.createDataFrame(rows, ATTEMPTS))


def test_resolve_attempts(resolved):
    got = {r.test_idx: r.status for r in resolved.collect()}
    assert [got[i] for i in range(len(RESOLVED))] == [want for _, want in RESOLVED.values()]


STATUSES = "task_id bigint, gen_idx bigint, variant int, test_idx int, status string"


@pytest.mark.parametrize("broadcast", [True, False])
def test_variant_fallback(spark, broadcast, request):
    if not broadcast:
        request.getfixturevalue("salted")
    rows = []
    for gen, first in {1: ["returncode:1"] * 2, 2: ["returncode:1", "false"], 3: ["returncode:2"] * 2}.items():
        rows += [(1, gen, 1, t, s) for t, s in enumerate(first)]
        rows += [(1, gen, 2, t, "passed") for t in range(2)]
    got = judging.variant_fallback(spark.createDataFrame(rows, STATUSES)).collect()
    assert sorted((r.gen_idx, r.test_idx, r.variant, r.status) for r in got) == [
        (1, 0, 2, "passed"),
        (1, 1, 2, "passed"),
        (2, 0, 1, "returncode:1"),
        (2, 1, 1, "false"),
        (3, 0, 1, "returncode:2"),
        (3, 1, 1, "returncode:2"),
    ]


def test_verdicts_of_unjudged_generations(spark):
    gens = spark.createDataFrame(
        [(1, 1, True), (1, 2, False), (1, 3, True)], "task_id bigint, gen_idx bigint, compiled boolean"
    )
    tests = spark.createDataFrame([(1, 3)], "task_id bigint, n_tests int")
    rows = [(1, 1, 1, t, 1, 0, False, False, out, "7") for t, out in enumerate(["7", "8", "7"])]
    verdicts = experiment.judge(gens, spark.createDataFrame(rows, ATTEMPTS), tests)
    got = {}
    for r in verdicts.orderBy("gen_idx", "test_idx").collect():
        got.setdefault(r.gen_idx, []).append(r.verdict)
    assert got == {1: [1, 0, 1], 2: [-2], 3: [-1, -1, -1]}


def test_broadcast_verdict(spark):
    verdicts = spark.createDataFrame(
        [(1, 1, 0, 1), (1, 2, 0, 0), (1, 2, 1, 1), (1, 4, 0, -2), (2, 3, 0, -3)],
        "task_id bigint, gen_idx bigint, test_idx int, verdict int",
    )
    tests = spark.createDataFrame([(1, 3), (2, 1)], "task_id bigint, n_tests int")
    got = judging.broadcast_verdict(verdicts, tests).collect()
    assert sorted((r.gen_idx, r.test_idx, r.verdict) for r in got) == [
        (1, 0, 1),
        (1, 1, 1),
        (1, 2, 1),
        (2, 0, 0),
        (2, 1, 1),
        (3, 0, -3),
        (4, 0, -2),
    ]


SAMPLES = {
    1: {"inputs": ["3\n4", ["5", "6"]], "outputs": ["7", ["8", "9"]]},
    2: {"inputs": [[{"1": "a", "-2": 3}], [1, 2]], "outputs": [{"1": [2]}, [{"3": 4}, 5]], "fn_name": "f"},
    3: {"inputs": [["x"]], "outputs": [{"k": 1}], "fn_name": "g"},
    4: {"inputs": [1, 2], "outputs": [1]},
    5: {"outputs": [1]},
    6: {"inputs": [], "outputs": []},
    7: {"inputs": [["1", 2]], "outputs": [{"1": 2}], "fn_name": None},
    8: {"inputs": ["a"], "outputs": ["b", "spare"]},
}


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(i, json.dumps(s)) for i, s in SAMPLES.items()]
    rows += [(20, '{"inputs": ['), (21, None), (22, '{"inputs": ["a"], "outputs": ["b"], '), (23, "[]")]
    return spark.createDataFrame(rows, "id bigint, input_output string")


def test_test_cases(samples):
    got = {(r.id, r.test_idx): r for r in judging.test_cases(samples).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (7, 0), (8, 0)}
    for (i, t), r in got.items():
        assert json.loads(r.input) == SAMPLES[i]["inputs"][t]
        assert json.loads(r.expected) == SAMPLES[i]["outputs"][t]
        call = SAMPLES[i].get("fn_name")
        assert r.fn_name == call
        assert r.test_type == ("call_based" if call else "standard_input")


def test_unreadable_samples(samples):
    got = {r.id: r.reason for r in judging.unreadable_samples(samples).collect()}
    assert got == {
        4: "missing_outputs",
        5: "no_inputs",
        20: "bad_json",
        21: "bad_json",
        22: "bad_json",
        23: "no_inputs",
    }


def test_normalise_io(samples):
    got = {(r.id, r.test_idx): r for r in judging.normalise_io(judging.test_cases(samples)).collect()}
    assert (got[1, 0].input, got[1, 0].expected) == ("3\n4", "7")
    assert (got[1, 1].input, got[1, 1].expected) == ("5\n6", "8\n9")
    assert got[2, 0].input_map == {1: '"a"', -2: "3"} and got[2, 0].expected_map == {1: "[2]"}
    assert got[2, 1].input_map is None and got[2, 1].expected_map == {3: "4"}
    assert got[3, 0].expected_map is None and json.loads(got[3, 0].expected) == {"k": 1}
    # A list that is not all strings cannot be joined.
    assert got[7, 0].input is None and got[7, 0].input_map is None


CODE = [
    ("none", ""),
    ("```python\nx = 1\n```", "x = 1"),
    ("a ```python  x```b```python\n\ny\n``` c", "x\ny"),
    ("```python\n```", ""),
    ("```python\nopen", ""),
    ("```py\nx\n```", ""),
    ("```python a ```python b ```", "a"),
    ("```python\xa0 z\x1f```", "z"),
]


def test_extract_code(spark):
    df = spark.createDataFrame([(1, i, c[0]) for i, c in enumerate(CODE)], "task_id bigint, gen_idx bigint, generated_text string")
    got = {r.gen_idx: r.code for r in generations.parse_generations(df).collect()}
    assert [got[i] for i in range(len(CODE))] == [c[1] for c in CODE]


def test_line_types(spark):
    code = "from a import *\nimport b\nfrom c import d\nx = 1\n  import e\n  from f import *\n"
    df = spark.createDataFrame([(1, 0, code)], "task_id bigint, gen_idx bigint, code string")
    got = {r.line_type: r.n_lines for r in generations.code_line_types(df).collect()}
    assert got == {2: 2, 1: 2, 0: 3}


def test_last_entry_wins(spark):
    rows = [(1, 0, 0, "old"), (1, 0, 1, "old"), (1, 3, 0, "new"), (2, 1, 0, "only")]
    df = spark.createDataFrame(rows, "task_id bigint, entry_pos int, gen_idx bigint, code string")
    got = sorted(map(tuple, generations.last_entry_per_task(df).collect()))
    assert got == [(1, 0, "new"), (2, 0, "only")]


def test_pairing(spark):
    made = spark.createDataFrame([(1,), (1,), (2,)], "task_id bigint")
    known = spark.createDataFrame([(1,), (3,)], "id bigint")
    got = {r.task_id: (r.n_generations, r.n_samples, r.status) for r in generations.pairing_report(made, known).collect()}
    assert got == {1: (2, 1, "paired"), 2: (1, 0, "no_sample"), 3: (0, 1, "no_generation")}


def test_unrecorded_variant_and_tasks_without_tests(spark):
    """A variant that was not recorded is not chosen; every generation has a verdict."""
    rows = [(1, 1, 1, t, 1, 1, False, False, "", "7") for t in range(2)]
    gens = spark.createDataFrame(
        [(1, 1, True), (2, 1, True)], "task_id bigint, gen_idx bigint, compiled boolean"
    )
    tests = spark.createDataFrame([(1, 2)], "task_id bigint, n_tests int")
    verdicts = experiment.judge(gens, spark.createDataFrame(rows, ATTEMPTS), tests)
    assert sorted((r.task_id, r.test_idx, r.verdict) for r in verdicts.collect()) == [
        (1, 0, -3),
        (1, 1, -3),
        (2, 0, -1),
    ]


def test_runs_are_told_apart(spark):
    """The same task and generation under two treatments and in two groups."""
    runs = [("no_context", "a", "7"), ("full_problem", "a", "8"), ("full_problem", "b", "7")]
    attempts = spark.createDataFrame(
        [(t, g, 1, 1, 1, 0, 1, 0, False, False, out, "7") for t, g, out in runs],
        f"context_type string, grp string, {ATTEMPTS}",
    )
    gens = attempts.selectExpr("context_type", "grp", "task_id", "gen_idx", "true as compiled")
    tests = judging.expected_tests(attempts)
    verdicts = experiment.judge(gens, attempts, tests, "strict", report.RUN_IN_GROUP)
    got = {(r.context_type, r.grp): r.pass_at_1 for r in report.run_results(verdicts).collect()}
    assert got == {("no_context", "a"): 1.0, ("full_problem", "a"): 0.0, ("full_problem", "b"): 1.0}


CALLS = [
    ("[1, 2]", "[1,2]", True),
    ("2.0", "[2]", True),
    ("1e15", "1000000000000000", True),
    ("1e20", "100000000000000000000", True),
    ("9007199254740993", "9007199254740992.0", False),
    ("-1e22", "-10000000000000000000000", True),
    ("-0.0", "0", True),
    ("1e23", "100000000000000000000000", False),
    ("1e23", "99999999999999991611392", True),
    ("0.5", "5e-1", True),
]


def test_call_based_tests_are_compared_as_values(spark):
    rows = [(1, 1, 1, t, 1, 0, False, False, *pair, "call_based") for t, (*pair, _) in enumerate(CALLS)]
    attempts = spark.createDataFrame(rows, f"{ATTEMPTS}, test_type string")
    got = {r.test_idx: r.status for r in judging.resolve_attempts(attempts, "strict").collect()}
    assert [got[i] for i in range(len(CALLS))] == ["passed" if same else "false" for *_, same in CALLS]


def test_only_call_based_verdicts_are_copied(spark, samples):
    verdicts = spark.createDataFrame(
        [(1, 1, 0, 1), (2, 1, 0, 1)], "task_id bigint, gen_idx bigint, test_idx int, verdict int"
    )
    tests = judging.tests_per_task(judging.test_cases(samples))
    got = judging.broadcast_verdict(verdicts, tests).collect()
    assert sorted((r.task_id, r.test_idx) for r in got) == [(1, 0), (2, 0), (2, 1)]


def test_one_parse_gives_tests_and_quarantine(spark, samples):
    odd = {30: {"inputs": [[7], "a", {"k": 1}], "outputs": ["x", "b", "y"]}, 31: {"inputs": ["q"], "outputs": [[1.5]]}}
    rows = [(i, json.dumps(s)) for i, s in odd.items()]
    every = samples.unionByName(spark.createDataFrame(rows, samples.schema))
    staged = judging.stage_samples(every)
    got = {(r.id, r.test_idx): r.reason for r in staged.quarantine.collect()}
    whole = {(r.id, None): r.reason for r in judging.unreadable_samples(every).collect()}
    assert got == whole | {(30, 0): "not_text", (30, 2): "not_text", (31, 0): "not_text", (7, 0): "not_text"}
    values = {(r.id, r.test_idx): r.input_output for r in staged.quarantine.collect()}
    assert json.loads(values[30, 2]) == {"inputs": {"k": 1}, "outputs": "y"}
    tests = {(r.id, r.test_idx): r for r in staged.tests.collect()}
    plain = {(r.id, r.test_idx): r for r in judging.normalise_io(judging.test_cases(every)).collect()}
    assert tests == {k: r for k, r in plain.items() if k not in got} and (30, 1) in tests
    sizes = {r.task_id: r.n_tests for r in staged.sizes.collect()}
    assert sizes == {r.task_id: r.n_tests for r in judging.tests_per_task(judging.test_cases(every)).collect()}


def test_generations_keep_their_run(spark):
    rows = [("g", t, 1, 0, f"```python\n{t}\n```") for t in ("no_context", "full_problem")]
    df = spark.createDataFrame(rows, "grp string, context_type string, task_id bigint, gen_idx bigint, generated_text string")
    got = generations.parse_generations(df, report.RUN_IN_GROUP)
    assert sorted(map(tuple, got.collect())) == sorted(("g", t, 1, 0, t) for t in ("no_context", "full_problem"))
