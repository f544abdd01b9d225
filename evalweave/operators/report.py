"""Run results, treatment comparison, stage durations and the run log."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave import schemas
from evalweave.functions import passk
from evalweave.operators import scoring

RUN = ("context_type", "task_id")
RUN_IN_GROUP = ("grp", *RUN)


def run_results(verdicts: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row per run: pass@1, normalised sum, treatment and the task's group.

    Verdicts carry the run's ``grp``, so that a task may be in several groups.
    For verdicts without it, ``groups`` maps task_id to grp; scores are aggregated
    before that join, which meets one row per run.
    """
    run = RUN_IN_GROUP if groups is None else RUN
    scored = results_of(scoring.task_totals(verdicts, run), run)
    if groups is not None:
        scored = scored.join(groups, "task_id")
    return scored.select(*RUN_IN_GROUP, "pass_at_1", "normalized_sum")


def results_of(totals: DataFrame, run: Sequence[str] = RUN_IN_GROUP) -> DataFrame:
    """``run_results`` from the totals of every run."""
    return totals.select(
        *run,
        passk.pass_at_k(F.col("n"), F.col("c"), F.lit(1)).alias("pass_at_1"),
        scoring.normalized_sum_value().alias("normalized_sum"),
    )


def context_delta(
    results: DataFrame,
    base: str = schemas.NO_CONTEXT,
    treatments: Sequence[str] = schemas.TREATMENTS,
) -> DataFrame:
    """Mean scores per group and treatment, and their difference from ``base``.

    A row of any other treatment than ``treatments`` fails the job.
    """
    scores = ("pass_at_1", "normalized_sum")
    treatment = F.col("context_type")
    unknown = F.raise_error(F.concat(F.lit("unknown treatment "), F.coalesce(treatment, F.lit("null"))))
    checked = F.when(treatment.isin(*treatments), treatment).otherwise(unknown.cast("string"))
    wide = (
        results.withColumn("context_type", checked)
        .groupBy("grp")
        .pivot("context_type", list(treatments))
        .agg(*[F.avg(s).alias(s) for s in scores])
    )
    columns: list[Column] = [F.col("grp")]
    for name in treatments:
        columns += [F.col(f"{name}_{s}") for s in scores]
    for name in treatments:
        if name != base:
            columns += [
                (F.col(f"{name}_{s}") - F.col(f"{base}_{s}")).alias(f"delta_{name}_{s}")
                for s in scores
            ]
    return wide.select(*columns)


def stage_durations(clock: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Seconds per run and stage, and per run with stage ``total``.

    ``clock``: the columns of ``by``, which tell runs apart, stage and ts. The total is taken
    from the stages' bounds.
    """
    stages = clock.groupBy(*by, "stage").agg(F.min("ts").alias("begin"), F.max("ts").alias("end"))
    run, stage = [F.col(c) for c in by], F.col("stage")
    bounds = stages.groupingSets([[*run, stage], run], *run, stage).agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.grouping("stage").alias("whole")
    )
    # An interval, as timestamps may come with or without time zone.
    elapsed = (F.col("end") - F.col("begin")).cast("interval second")
    seconds = elapsed.cast("decimal(18,6)").cast("double")
    name = F.when(F.col("whole") == 1, "total").otherwise(stage)
    return bounds.select(*by, name.alias("stage"), seconds.alias("seconds"))


def run_name(parts: Sequence[str] = ("task_id", "context_type", "grp")) -> Column:
    return F.concat_ws("_", *[F.col(p).cast("string") for p in parts])


def run_log(
    results: DataFrame,
    durations: DataFrame | None = None,
    stages: Sequence[str] = (),
    grid: DataFrame | None = None,
) -> DataFrame:
    """Results as logged: with the run's name, seconds per stage and index in the grid.

    ``durations`` is from ``stage_durations``, by the columns of a run, or with the task as
    run_id where a task has one run only; ``grid`` from the run grid. All three have one row
    per run when they are joined.
    """
    logged = results.withColumn("run_name", run_name())
    if durations is not None:
        if "run_id" in durations.columns:
            durations = durations.withColumnRenamed("run_id", "task_id")
        run = [c for c in durations.columns if c not in ("stage", "seconds")]
        wide = durations.groupBy(*run).pivot("stage", list(stages)).agg(F.max("seconds"))
        named = wide.withColumnsRenamed({s: f"{s}_seconds" for s in stages})
        logged = logged.join(named, run, "left")
    if grid is not None:
        index = grid.select("context_type", "grp", F.col("target_id").alias("task_id"), "run_index")
        logged = logged.join(index, ["context_type", "grp", "task_id"], "left")
    return logged
