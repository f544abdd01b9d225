"""Scores from verdicts: pass@k, normalised sums, histograms.

Verdicts are long rows ``(keys..., gen_idx, test_idx, verdict)``. Vectors have no
gaps: test positions run from 0 to the vector's length - 1. An empty vector is a
row with null ``test_idx`` and ``verdict`` (see ``explode_results``) and counts
as correct; a generation that could not be judged needs a verdict row, else it
is not counted.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave import schemas
from evalweave.functions import passk
from evalweave.operators import skew

TASK = ("task_id",)


def explode_results(results: DataFrame) -> DataFrame:
    """Long rows from ``(task_id, gen_idx, verdicts array)``; keeps empty vectors."""
    others = [c for c in results.columns if c != "verdicts"]
    return results.select(*others, F.posexplode_outer("verdicts").alias("test_idx", "verdict")).withColumn(
        "verdict", F.col("verdict").cast("int")
    )


def collect_results(verdicts: DataFrame, by: Sequence[str] = TASK) -> DataFrame:
    """One row per generation with its ``verdicts`` array, the inverse of ``explode_results``.

    For exports: an array is as long as the problem has tests.
    """
    cell = F.when(F.col("test_idx").isNotNull(), F.struct("test_idx", "verdict"))
    cells = verdicts.groupBy(*by, "gen_idx").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return cells.select(*by, "gen_idx", F.col("cells.verdict").alias("verdicts"))


def _passed() -> Column:
    return F.col("verdict") == schemas.PASSED


def generation_correct(verdicts: DataFrame, by: Sequence[str] = TASK) -> DataFrame:
    """Per generation: all verdicts positive, passed tests, vector length."""
    return verdicts.groupBy(*by, "gen_idx").agg(
        F.coalesce(F.min("verdict") > 0, F.lit(True)).alias("correct"),
        F.count_if(_passed()).alias("hits"),
        F.coalesce(F.max("test_idx") + 1, F.lit(0)).alias("n_tests"),
    )


def task_totals(verdicts: DataFrame, by: Sequence[str] = TASK) -> DataFrame:
    """Per task: generations ``n``, correct ones ``c``, passed tests, longest vector.

    Both levels aggregate before they shuffle, so a hot task costs its key one
    row per map task.
    """
    return (
        generation_correct(verdicts, by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("correct").alias("c"),
            F.sum("hits").alias("hits"),
            F.max("n_tests").alias("max_tests"),
        )
    )


def vector_totals(results: DataFrame, by: Sequence[str] = TASK) -> DataFrame:
    """``task_totals`` of rows that hold a generation's whole ``verdicts`` array.

    Nothing has to be brought together per generation, so one aggregate, combined
    before its only shuffle, is enough. Works on streams too.
    """
    passed = F.filter("verdicts", lambda v: v == schemas.PASSED)
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.forall("verdicts", lambda v: v > 0)).alias("c"),
        F.sum(F.size(passed).cast("long")).alias("hits"),
        F.max(F.size("verdicts")).alias("max_tests"),
    )


def _with_k(totals: DataFrame, ks: Sequence[int]) -> DataFrame:
    if not ks or min(ks) < 1:
        raise ValueError("every k must be at least 1")
    return totals.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))


def _estimate() -> Column:
    return passk.pass_at_k(F.col("n"), F.col("c"), F.col("k"))


def pass_at_k_detail(totals: DataFrame, ks: Sequence[int], within: Sequence[str] = ()) -> DataFrame:
    """pass@k per task, for each k that every task has enough generations for.

    The tasks that count are those that agree in the columns ``within``, such as the
    treatment. ``totals`` is read twice, for the smallest n and for the rows: store it
    first if it is expensive.
    """
    if not within:
        fewest = totals.agg(F.min("n")).scalar()
        return _with_k(totals, ks).filter(F.col("k") <= fewest).withColumn("pass_at_k", _estimate())
    least = totals.groupBy(*within).agg(F.min("n").alias("fewest"))
    rows = skew.attach(totals, least, within, ["task_id"])
    return _with_k(rows, ks).filter("k <= fewest").drop("fewest").withColumn("pass_at_k", _estimate())


def pass_at_k(totals: DataFrame, ks: Sequence[int], within: Sequence[str] = ()) -> DataFrame:
    """Mean pass@k over tasks, for the same k as ``pass_at_k_detail``, per value of ``within``."""
    return (
        _with_k(totals, ks)
        .groupBy(*within, "k")
        .agg(F.avg(_estimate()).alias("pass_at_k"), F.min("n").alias("fewest"))
        .filter(F.col("k") <= F.col("fewest"))
        .select(*within, "k", "pass_at_k")
    )


def tests_passed_by_position(verdicts: DataFrame, by: Sequence[str] = TASK) -> DataFrame:
    """Passed generations per test position, zero where none passed."""
    return (
        verdicts.filter(F.col("test_idx").isNotNull())
        .groupBy(*by, "test_idx")
        .agg(F.count_if(_passed()).alias("n_passed"))
    )


def normalized_sum_value() -> Column:
    cells = F.col("n") * F.col("max_tests")
    return F.when(cells > 0, F.col("hits") / cells).otherwise(0.0)


def normalized_sum(totals: DataFrame) -> DataFrame:
    """Passed tests over generations x longest vector, per task; 0 if no tests."""
    return totals.withColumn("total", normalized_sum_value())


def verdict_histogram(verdicts: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in schemas.STATUS_NAMES.items() for x in pair])
    return (
        verdicts.filter(F.col("verdict").isNotNull())
        .groupBy("verdict")
        .agg(F.count(F.lit(1)).alias("n_tests"))
        .withColumn("status", F.try_element_at(names, F.col("verdict")))
    )
