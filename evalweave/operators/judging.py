"""From recorded attempts to verdicts, one row per (task, generation, test).

``by`` names the columns that a run is told apart by: the task alone, or also its
treatment and group. Generations are numbered within a run.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave import schemas, scratch
from evalweave.functions import calls, compare
from evalweave.operators import skew
from evalweave.operators.scoring import TASK

# Statuses of one judged test.
STATUS_PASSED = "passed"
STATUS_FALSE = "false"
STATUS_TIMEOUT = "timeout"
STATUS_RUNTIME = "runtime_error"
RETURN_CODE = "returncode:"
FAILED_START_CODE = 1
FAILED_START = f"{RETURN_CODE}{FAILED_START_CODE}"

# How a problem's tests are run.
CALL_BASED = "call_based"
STANDARD_INPUT = "standard_input"


def _opened(samples: DataFrame) -> DataFrame:
    fields = "inputs array<variant>, outputs array<variant>, fn_name string"
    return samples.select("id", "input_output", F.from_json("input_output", fields).alias("doc"))


def _is_complete() -> Column:
    """Whether the document has inputs, and an output for each."""
    sizes = F.size("doc.outputs") >= F.size("doc.inputs")
    return F.coalesce(F.col("doc.inputs").isNotNull() & sizes, F.lit(False))


def test_cases(samples: DataFrame) -> DataFrame:
    """One row per test of every readable sample, values as JSON text.

    Documents are parsed once: unreadable ones explode to a row without position,
    which is dropped, instead of being filtered by a second parse.
    """
    pairs = F.arrays_zip("doc.inputs", "doc.outputs")
    kind = F.when(F.col("fn_name").isNull(), STANDARD_INPUT).otherwise(CALL_BASED)
    return (
        _opened(samples)
        .select(
            "id",
            F.col("doc.fn_name").alias("fn_name"),
            F.col("doc.inputs").alias("inputs"),
            F.posexplode_outer(F.when(_is_complete(), pairs)).alias("test_idx", "test"),
        )
        .filter(F.col("test_idx").isNotNull() & (F.col("test_idx") < F.size("inputs")))
        .select(
            "id",
            "test_idx",
            kind.alias("test_type"),
            "fn_name",
            F.to_json("test.inputs").alias("input"),
            F.to_json("test.outputs").alias("expected"),
        )
    )


test_cases.__test__ = False


def unreadable_samples(samples: DataFrame) -> DataFrame:
    """Samples no test can be taken from, with the reason."""
    return (
        _opened(samples)
        .filter(~_is_complete())
        .select("id", "input_output", _reason().alias("reason"))
    )


def _reason() -> Column:
    """What is wrong with an opened sample; null where nothing is."""
    return (
        F.when(_is_complete(), None)
        .when(F.try_parse_json("input_output").isNull(), "bad_json")
        .when(F.col("doc.inputs").isNull(), "no_inputs")
        .otherwise("missing_outputs")
    )


def _stdin_text(value: Column, listed: Column) -> Column:
    """A string as it is, a list of strings joined by newline, else null."""
    strings = F.transform(listed, lambda v: F.try_variant_get(v, "$", "string"))
    only_strings = F.forall(listed, lambda v: F.schema_of_variant(v) == "STRING")
    return F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")
    ).when(only_strings, F.array_join(strings, "\n"))


def _object(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "map<string,variant>")


def _int_keyed(entries: Column) -> Column:
    """The map with integer keys; null if a key is no integer or two are equal."""
    keys = F.transform(F.map_keys(entries), lambda k: k.try_cast("bigint"))
    usable = F.forall(keys, lambda k: k.isNotNull()) & (F.size(F.array_distinct(keys)) == F.size(keys))
    texts = F.transform(F.map_values(entries), lambda v: F.to_json(v))
    return F.when(usable, F.map_from_arrays(keys, texts))


_CASE = ("id", "test_idx", "test_type", "fn_name", "input", "expected")


def normalise_io(tests: DataFrame) -> DataFrame:
    """Tests with their values in the form they are run and compared.

    Standard input and output become text. Values of call-based tests that are a
    JSON object, or a list starting with one, also get the integer-keyed map that
    object stands for (``input_map``, ``expected_map``).
    """
    # Each value is parsed in a step of its own, as later steps use it repeatedly.
    parsed = tests.select(
        *_CASE, F.try_parse_json("input").alias("given"), F.try_parse_json("expected").alias("wanted")
    )
    return _normalised(parsed).select(*_CASE, "input_map", "expected_map")


def _normalised(parsed: DataFrame) -> DataFrame:
    """``normalise_io`` of rows with the variants ``given`` and ``wanted``; other columns stay."""
    is_stdin = F.col("test_type") == STANDARD_INPUT
    given, wanted = F.col("given"), F.col("wanted")
    opened = parsed.select(
        "*",
        F.when(is_stdin, F.try_variant_get(given, "$", "array<variant>")).alias("given_list"),
        F.when(is_stdin, F.try_variant_get(wanted, "$", "array<variant>")).alias("wanted_list"),
        F.when(~is_stdin, _object(given, "$[0]")).alias("given_entries"),
        F.when(~is_stdin, F.coalesce(_object(wanted, "$"), _object(wanted, "$[0]"))).alias("wanted_entries"),
    )
    return opened.withColumns({
        "input": F.when(is_stdin, _stdin_text(given, F.col("given_list"))).otherwise(F.col("input")),
        "expected": F.when(is_stdin, _stdin_text(wanted, F.col("wanted_list"))).otherwise(F.col("expected")),
        "input_map": _int_keyed(F.col("given_entries")),
        "expected_map": _int_keyed(F.col("wanted_entries")),
    }).drop("given", "wanted", "given_list", "wanted_list", "given_entries", "wanted_entries")


@dataclass(frozen=True)
class Staged:
    """Samples after their one parse: ``tests`` as of ``normalise_io``, what none can be taken from as
    ``quarantine`` (id, test_idx, input_output, reason), and ``sizes`` as of ``tests_per_task``."""

    tests: DataFrame
    quarantine: DataFrame
    sizes: DataFrame


def stage_samples(samples: DataFrame) -> Staged:
    """Parse every sample once and write its tests and what is wrong with it to one table.

    The table is partitioned by outcome, so reading one does not read the other. Besides whole samples
    (``test_idx`` null, with the reasons of ``unreadable_samples``), tests on standard input whose
    input or output is neither a text nor a list of texts are quarantined as ``not_text``, with
    their values; they count among their problem's tests.
    """
    pairs = F.arrays_zip("doc.inputs", "doc.outputs")
    kind = F.when(F.col("doc.fn_name").isNull(), STANDARD_INPUT).otherwise(CALL_BASED)
    rows = _opened(samples).select(
        "id",
        F.when(~_is_complete(), F.col("input_output")).alias("input_output"),
        _reason().alias("wrong"),
        kind.alias("test_type"),
        F.col("doc.fn_name").alias("fn_name"),
        F.size("doc.inputs").alias("n_tests"),
        F.posexplode_outer(F.when(_is_complete(), pairs)).alias("test_idx", "test"),
    )
    # Spare outputs have no test; a complete sample without inputs has neither.
    rows = rows.filter(F.col("wrong").isNotNull() | (F.col("test_idx") < F.col("n_tests")))
    cases = _normalised(
        rows.select(
            "id", "test_idx", "test_type", "fn_name", "wrong", "input_output",
            F.to_json("test.inputs").alias("input"), F.to_json("test.outputs").alias("expected"),
            F.to_json("test").alias("values"), F.col("test.inputs").alias("given"), F.col("test.outputs").alias("wanted"),
        )
    )
    no_text = F.col("input").isNull() | F.col("expected").isNull()
    reason = F.coalesce("wrong", F.when(no_text, "not_text"))
    staged = cases.select(
        *_CASE, "input_map", "expected_map",
        F.when(reason.isNotNull(), F.coalesce("input_output", "values")).alias("input_output"),
        reason.alias("reason"),
        F.when(reason.isNull(), "tests").otherwise("quarantine").alias("outcome"),
    )
    path = scratch.new_path(samples.sparkSession, "staged")
    staged.write.partitionBy("outcome").parquet(path)
    table = samples.sparkSession.read.schema(staged.schema).parquet(path)
    return Staged(
        tests=table.filter("outcome = 'tests'").select(*_CASE, "input_map", "expected_map"),
        quarantine=table.filter("outcome = 'quarantine'").select("id", "test_idx", "input_output", "reason"),
        sizes=tests_per_task(table.filter("test_idx is not null")),
    )


def compare_calls(results: DataFrame, mode: str = "strict") -> DataFrame:
    """Adds ``matched`` to rows with JSON columns ``actual`` and ``expected``."""
    return results.withColumn(
        "matched", calls.calls_match(F.col("actual"), F.col("expected"), mode)
    )


def output_matches(attempts: DataFrame, mode: str) -> Column:
    """Whether an attempt's output is the expected one; one that was not recorded is not."""
    stdout, expected = F.col("stdout"), F.col("expected")
    same = compare.outputs_match(stdout, expected, mode)
    if "test_type" in attempts.columns:
        called = calls.calls_match(stdout, expected, mode)
        same = F.when(F.col("test_type") == CALL_BASED, called).otherwise(same)
    return F.coalesce(same, F.lit(False))


def resolve_attempts(
    attempts: DataFrame, mode: str = "strict", by: Sequence[str] = TASK
) -> DataFrame:
    """The status of every test from its up to three recorded attempts.

    ``attempts``: the columns of ``by``, gen_idx, variant, test_idx, attempt (1..3),
    exit_code, timed_out, launch_error, stdout, expected and, if some problems are
    call-based, test_type. Outputs are compared before the shuffle, so texts stay
    where they were read and only flags are exchanged.
    """
    a = F.col
    key = [*by, "gen_idx"]
    same = output_matches(attempts, mode)
    finished = ~a("timed_out") & ~a("launch_error")
    succeeded = finished & (a("exit_code") == 0)
    matched = F.when(succeeded, same)
    flags = attempts.select(
        *key,
        "variant",
        "test_idx",
        "attempt",
        ((a("attempt") == 1) & a("timed_out")).alias("first_timed_out"),
        ((a("attempt") == 1) & a("launch_error")).alias("first_not_launched"),
        F.when(succeeded, a("attempt")).alias("good_attempt"),
        matched.alias("matched"),
        F.when(finished, a("attempt")).alias("finished_attempt"),
        a("exit_code"),
    )
    resolved = flags.groupBy(*key, "variant", "test_idx").agg(
        F.bool_or("first_timed_out").alias("timed_out"),
        F.bool_or("first_not_launched").alias("not_launched"),
        F.min_by("matched", "good_attempt").alias("matched"),
        F.max_by("exit_code", "finished_attempt").alias("last_code"),
    )
    status = (
        F.when(F.col("timed_out"), STATUS_TIMEOUT)
        .when(F.col("not_launched"), STATUS_RUNTIME)
        .when(F.col("matched"), STATUS_PASSED)
        .when(~F.col("matched"), STATUS_FALSE)
        .otherwise(F.concat(F.lit(RETURN_CODE), F.col("last_code").cast("string")))
    )
    return resolved.select(*key, "variant", "test_idx", status.alias("status"))


def variant_fallback(statuses: DataFrame, by: Sequence[str] = TASK) -> DataFrame:
    """Results of variant 2 where every test of variant 1 ended with exit code 1.

    Where variant 2 was not recorded, those of variant 1 stay. A generation's statuses
    meet in one exchange; to judge whole runs, ``outcomes`` decides on fewer rows.
    """
    generation = Window.partitionBy(*by, "gen_idx")
    failed_start = F.when(F.col("variant") == 1, F.col("status") == FAILED_START)
    failed = F.coalesce(F.bool_and(failed_start).over(generation), F.lit(True))
    has_other = F.bool_or(F.col("variant") == 2).over(generation)
    chosen = F.when(failed & has_other, 2).otherwise(1)
    return (
        statuses.withColumn("chosen", chosen)
        .filter(F.col("variant") == F.col("chosen"))
        .select(*by, "gen_idx", "test_idx", "variant", "status")
    )


def expected_tests(verdicts: DataFrame) -> DataFrame:
    """Number of tests per task: the longest vector recorded for it."""
    return verdicts.groupBy("task_id").agg((F.max("test_idx") + 1).alias("n_tests"))


def tests_per_task(cases: DataFrame) -> DataFrame:
    """``(task_id, n_tests, test_type)`` as the problems have them, from ``test_cases``."""
    return cases.groupBy(F.col("id").alias("task_id")).agg(
        (F.max("test_idx") + 1).alias("n_tests"), F.min("test_type").alias("test_type")
    )


def broadcast_verdict(
    verdicts: DataFrame, tests: DataFrame, by: Sequence[str] = TASK
) -> DataFrame:
    """A judged generation with a single verdict has it for all tests of its task.

    The verdict itself, at position 0, stays; only its copies are added. The single
    verdict of a program that did not compile is not copied. If ``tests`` has
    test_type, only verdicts of call-based tasks are.
    """
    key = [*by, "gen_idx"]
    if "test_type" in tests.columns:
        tests = tests.filter(F.col("test_type") == CALL_BASED)
    single = (
        verdicts.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_verdicts"), F.max("verdict").alias("verdict"))
        .filter((F.col("n_verdicts") == 1) & (F.col("verdict") != schemas.COMPILE_ERROR))
        .drop("n_verdicts")
    )
    columns = [*key, "test_idx", "verdict"]
    counts = tests.filter(F.col("n_tests") > 1).select("task_id", "n_tests")
    copies = skew.attach(single, counts, ["task_id"], ["gen_idx"]).withColumn(
        "test_idx", F.explode(F.sequence(F.lit(1), F.col("n_tests") - 1))
    )
    return verdicts.select(*columns).unionByName(copies.select(*columns))
