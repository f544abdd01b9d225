"""All results of a generation in one row, as bitmaps by status.

A word holds 64 tests. What every recorded attempt says about its test is one bit in one
of a few words, so attempts are combined with ``bit_or`` and a generation's tests
are decided together: which attempt counts, which program variant, whether the
program compiled or left no result, and whether a single verdict stands for all tests.

``by`` names the columns that a run is told apart by, as in ``judging``.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave import schemas, scratch
from evalweave.operators import judging, skew
from evalweave.operators.scoring import TASK

BITS = 64
ATTEMPTS = (1, 2, 3)
# What an attempt says of its test, the deciding ones first.
_TIMED_OUT, _NOT_STARTED = "timed_out", "not_started"


def _right(attempt: int) -> str:
    return f"right_{attempt}"


def _wrong(attempt: int) -> str:
    return f"wrong_{attempt}"


def _failed(attempt: int) -> str:
    return f"failed_{attempt}"


def _ended(attempt: int) -> str:
    return f"ended_{attempt}"


# Of several attempts the first that ran through counts, else the last that ended.
PRIORITY = (
    _TIMED_OUT,
    _NOT_STARTED,
    *[kind(k) for k in ATTEMPTS for kind in (_right, _wrong)],
    *[kind(k) for k in reversed(ATTEMPTS) for kind in (_failed, _ended)],
)


def _said(attempts: DataFrame, mode: str) -> Column:
    """Which of ``PRIORITY`` an attempt is, by its place; its length if it says nothing."""
    attempt, code = F.col("attempt"), F.col("exit_code")
    same = judging.output_matches(attempts, mode)
    ended = ~F.col("timed_out") & ~F.col("launch_error") & code.isNotNull()
    place = {name: i for i, name in enumerate(PRIORITY)}

    def numbered(kind) -> Column:
        """The place of ``kind`` for this attempt."""
        step = place[kind(2)] - place[kind(1)]
        return F.lit(place[kind(1)] - step) + step * attempt

    return (
        F.when((attempt == 1) & F.col("timed_out"), place[_TIMED_OUT])
        .when((attempt == 1) & F.col("launch_error"), place[_NOT_STARTED])
        .when(~ended, len(PRIORITY))
        .when((code == 0) & same, numbered(_right))
        .when(code == 0, numbered(_wrong))
        .when(code == judging.FAILED_START_CODE, numbered(_failed))
        .otherwise(numbered(_ended))
    )


def _first(row: Sequence[str]) -> dict[str, Column]:
    """Each plane without the tests that an earlier one has decided."""
    taken, out = F.lit(0).cast("long"), {}
    for name in row:
        out[name] = F.col(name).bitwiseAND(F.bitwise_not(taken))
        taken = taken.bitwiseOR(F.col(name))
    return out


def _union(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total.bitwiseOR(column)
    return total


def by_generation(
    generations: DataFrame,
    attempts: DataFrame,
    mode: str = "effective",
    by: Sequence[str] = TASK,
    dealt: bool = False,
) -> DataFrame:
    """``(by, gen_idx, compiled, words)``: one row per generation listed or attempted.

    ``words`` has ``(word, seen, passed, wrong, late)`` for every 64 tests with a result, of the
    program variant that counts: the second where it was recorded and every test of the
    first ended with exit code 1. ``compiled`` is null for a generation that is not listed.

    One exchange, by generation: attempts travel as one number each, with the
    generations' own rows among them instead of a join. If attempts come ``dealt`` by generation, they
    are combined where they lie, and what travels is a row for 64 tests.
    """
    key = [*by, "gen_idx"]
    test = F.col("test_idx")
    told = attempts.select(
        *key,
        F.col("variant").cast("int").alias("variant"),
        F.shiftright(test, 6).cast("int").alias("word"),
        F.expr("shiftleft(1L, test_idx & 63)").alias("bit"),
        _said(attempts, mode).cast("int").alias("said"),
        F.lit(None).cast("boolean").alias("compiled"),
    )
    none = F.lit(0).cast("long")
    if not dealt:
        absent = [F.lit(None).cast(kind).alias(name) for name, kind in (("variant", "int"), ("word", "int"))]
        listed = generations.select(*key, *absent, none.alias("bit"), F.lit(len(PRIORITY)).alias("said"), "compiled")
        told = told.unionByName(listed).repartition(*[F.col(k) for k in key])
    planes = told.groupBy(*key, "variant", "word").agg(
        F.bit_or("bit").alias("seen"),
        F.bool_and("compiled").alias("compiled"),
        *[F.bit_or(F.when(F.col("said") == i, F.col("bit")).otherwise(none)).alias(p) for i, p in enumerate(PRIORITY)],
    )
    decided = _first(PRIORITY)
    known = _union([F.col(p) for p in PRIORITY])
    failed = _union([decided[_failed(k)] for k in ATTEMPTS])
    words = planes.select(
        *key,
        "variant",
        "compiled",
        F.struct(
            "word",
            "seen",
            _union([decided[_right(k)] for k in ATTEMPTS]).alias("passed"),
            _union([decided[_wrong(k)] for k in ATTEMPTS]).alias("wrong"),
            decided[_TIMED_OUT].alias("late"),
        ).alias("tests"),
        (known == failed).alias("all_failed"),
    )
    if dealt:
        absent = [F.lit(None).cast(words.schema[c].dataType).alias(c) for c in ("variant", "tests", "all_failed")]
        words = words.unionByName(generations.select(*key, "compiled", *absent))
    first, other = F.col("variant") == 1, F.col("variant") == 2
    whole = words.groupBy(*key).agg(
        F.bool_and("compiled").alias("compiled"),
        F.coalesce(F.bool_and(F.when(first, F.col("all_failed"))), F.lit(True)).alias("failed"),
        F.collect_list(F.when(first, F.col("tests"))).alias("first"),
        F.collect_list(F.when(other, F.col("tests"))).alias("other"),
    )
    takes_other = F.col("failed") & (F.size("other") > 0)
    return whole.select(*key, "compiled", F.when(takes_other, F.col("other")).otherwise(F.col("first")).alias("words"))


def settled(
    outcomes: DataFrame, tests: DataFrame, by: Sequence[str] = TASK, listed: DataFrame | None = None
) -> DataFrame:
    """Rows of ``by_generation`` with ``fill`` and ``n_fill``: a verdict for tests without a result.

    A generation that did not compile has the single verdict -2 and no words. One without
    any result has -1 for each test of its task in ``tests`` (task_id, n_tests), and one
    -1 if the task has none there. If ``tests`` has test_type, a call-based generation with a
    single verdict, at position 0, has it for all tests.

    A task's row in ``tests`` is copied only where very many generations need it, counted in
    ``listed``, a cheaper table of the generations, if it is given.
    """
    called = "test_type" in tests.columns
    counts = tests.select("task_id", "n_tests", *(["test_type"] if called else []))
    counts = scratch.write(counts, "tests")
    hot = None
    if counts.bytes > skew.BROADCAST_BYTES:
        hot = skew.hot_keys(outcomes if listed is None else listed, ["task_id"])
    placed = skew.spread(outcomes, counts, ["task_id"], ["gen_idx"], hot, "left")
    broken = F.col("compiled").isNotNull() & ~F.col("compiled")
    silent = F.size("words") == 0
    one = F.get("words", F.lit(0))
    single = (F.size("words") == 1) & (one["word"] == 0) & (one["seen"] == 1)
    n_tests = F.greatest(F.coalesce("n_tests", F.lit(1)), F.lit(1)).cast("int")
    spread = single & (F.col("test_type") == judging.CALL_BASED) if called else F.lit(False)
    spread = F.coalesce(spread, F.lit(False))
    own = _code(one, F.lit(0))
    fill = (
        F.when(broken, schemas.COMPILE_ERROR)
        .when(silent, schemas.TIMEOUT)
        .when(spread, own)
    )
    n_fill = F.when(broken, 1).when(silent | spread, n_tests).otherwise(0)
    empty = F.filter("words", lambda w: F.lit(False))
    return placed.select(
        *by,
        "gen_idx",
        F.when(broken | spread, empty).otherwise(F.col("words")).alias("words"),
        fill.alias("fill"),
        n_fill.alias("n_fill"),
    )


def _bit(word: Column, place: Column) -> Column:
    return F.getbit(word, place) == 1


def _code(tests: Column, place: Column) -> Column:
    """The verdict of the test at ``place`` of a word."""
    return (
        F.when(_bit(tests["passed"], place), schemas.PASSED)
        .when(_bit(tests["wrong"], place), schemas.FALSE)
        .when(_bit(tests["late"], place), schemas.TIMEOUT)
        .otherwise(schemas.RUNTIME_ERROR)
    )


def _length(word: Column) -> Column:
    """The place of the highest bit, and one."""
    return F.length(F.bin(word))


def verdicts(rows: DataFrame, by: Sequence[str] = TASK) -> DataFrame:
    """Long verdict rows ``(by, gen_idx, test_idx, verdict)`` of ``settled`` generations."""
    tests, place, fill = F.col("tests"), F.col("place"), F.col("fill")
    empty = F.struct(F.lit(0).alias("word"), *[F.lit(0).cast("long").alias(n) for n in ("seen", "passed", "wrong", "late")])
    length = F.when(fill.isNotNull(), F.col("n_fill")).otherwise(_length(tests["seen"]))
    return (
        rows.withColumn("tests", F.explode(F.when(fill.isNotNull(), F.array(empty)).otherwise(F.col("words"))))
        .withColumn("place", F.explode(F.sequence(F.lit(0), length - 1)))
        .filter(fill.isNotNull() | _bit(tests["seen"], place))
        .select(
            *by,
            "gen_idx",
            (tests["word"] * BITS + place).alias("test_idx"),
            F.coalesce(fill, _code(tests, place)).alias("verdict"),
        )
    )


def generation_scores(rows: DataFrame, by: Sequence[str] = TASK) -> DataFrame:
    """Per ``settled`` generation: all verdicts positive, passed tests, vector length."""
    passed = F.col("fill") == schemas.PASSED
    filled = F.col("fill").isNotNull()
    right = F.forall("words", lambda w: w["seen"] == w["passed"])
    hits = F.aggregate("words", F.lit(0), lambda s, w: s + F.bit_count(w["passed"]))
    length = F.aggregate("words", F.lit(0), lambda s, w: F.greatest(s, w["word"] * BITS + _length(w["seen"])))
    return rows.select(
        *by,
        "gen_idx",
        F.when(filled, passed).otherwise(right).alias("correct"),
        F.when(filled, F.when(passed, F.col("n_fill")).otherwise(0)).otherwise(hits).cast("long").alias("hits"),
        F.when(filled, F.col("n_fill")).otherwise(length).alias("n_tests"),
    )


def task_totals(rows: DataFrame, by: Sequence[str] = TASK) -> DataFrame:
    """``scoring.task_totals`` from ``settled`` generations, without rows per test."""
    return (
        generation_scores(rows, by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("correct").alias("c"),
            F.sum("hits").alias("hits"),
            F.max("n_tests").alias("max_tests"),
        )
    )
