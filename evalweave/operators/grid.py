"""The run grid, its slice, and the generation requests of each run."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave import schemas
from evalweave.operators import skew


def run_grid(
    targets: DataFrame,
    treatments: Sequence[str] = schemas.TREATMENTS,
    start: int = 0,
    end: int | None = None,
    end_inclusive: bool = False,
) -> DataFrame:
    """Every treatment of every target with its running index, then the slice.

    The index counts treatments first, then groups by name, then positions.
    ``total_runs`` counts the whole grid, also outside the slice.
    """
    numbered = skew.global_index(
        targets.select("grp", "target_id", "target_pos"), ["grp", "target_pos"], "target_index"
    )
    count = numbered.rows
    names = F.array(*[F.lit(t) for t in treatments])
    grid = numbered.df.select(
        "grp", "target_id", "target_pos", "target_index", F.posexplode(names).alias("t", "context_type")
    ).select(
        (F.col("t") * F.lit(count) + F.col("target_index")).cast("long").alias("run_index"),
        "context_type",
        "grp",
        "target_id",
        "target_pos",
        F.lit(count * len(treatments)).cast("long").alias("total_runs"),
    )
    kept = grid.filter(F.col("run_index") >= start)
    if end is None:
        return kept
    index = F.col("run_index")
    return kept.filter(index <= end if end_inclusive else index < end)


def generation_requests(runs: DataFrame, n_generations: int, batch_size: int) -> DataFrame:
    """One row per generation to ask for, in full batches of ``batch_size``.

    ``n_left_out`` is the remainder no full batch covers.
    """
    if batch_size < 1 or n_generations < 1:
        raise ValueError("n_generations and batch_size must be positive")
    if batch_size > n_generations:
        raise ValueError(
            f"batch_size ({batch_size}) must not exceed n_generations ({n_generations})"
        )
    asked = n_generations // batch_size * batch_size
    return runs.select(
        "*",
        F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("gen_idx"),
        F.lit(n_generations - asked).alias("n_left_out"),
    ).withColumn("batch", F.floor(F.col("gen_idx") / batch_size).cast("int"))
