"""Recorded generations: code extraction, line census, pairing."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text
from evalweave.operators import skew
from evalweave.operators.scoring import TASK

# The fence around code, and the marks of import lines.
FENCED_CODE = r"(?s)```python(.*?)```"
STAR_IMPORT = "import *"
IMPORT_STARTS = ("from ", "import ")


def extract_code(generated: Column) -> Column:
    """Fenced blocks, each stripped, joined by newline; empty if there is none."""
    blocks = F.regexp_extract_all(generated, F.lit(FENCED_CODE), F.lit(1))
    return F.array_join(F.transform(blocks, text.strip), "\n")


def parse_generations(generations: DataFrame, by: Sequence[str] = TASK) -> DataFrame:
    """The code of every generation. ``by`` names the columns of a run, such as its treatment."""
    return generations.select(*by, "gen_idx", extract_code(F.col("generated_text")).alias("code"))


def last_entry_per_task(entries: DataFrame) -> DataFrame:
    """Generations of each task's last entry; an entry lists one task's outputs.

    ``entries`` has one row per output with the entry's ``entry_pos``. Only the
    positions are aggregated; no task's outputs are gathered in one row.
    """
    last = entries.groupBy("task_id").agg(F.max("entry_pos").alias("entry_pos"))
    kept = skew.attach(entries, last, ["task_id", "entry_pos"], ["gen_idx"], "left_semi")
    return kept.select("task_id", "gen_idx", "code")


def line_type(line: Column) -> Column:
    """2 for a star import, 1 for another import, 0 for other code."""
    starts = line.startswith(IMPORT_STARTS[0]) | line.startswith(IMPORT_STARTS[1])
    return F.when(line.contains(STAR_IMPORT), 2).when(starts, 1).otherwise(0)


def code_line_types(parsed: DataFrame) -> DataFrame:
    """Lines of each type per task."""
    lines = parsed.select("task_id", F.explode(F.split("code", "\n")).alias("line"))
    return (
        lines.groupBy("task_id", line_type(F.col("line")).alias("line_type"))
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


def pairing_report(generations: DataFrame, samples: DataFrame) -> DataFrame:
    """How many generations and samples each task has, and whether they pair up."""
    made = generations.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_generations"))
    known = samples.groupBy(F.col("id").alias("task_id")).agg(F.count(F.lit(1)).alias("n_samples"))
    status = (
        F.when(F.col("n_samples").isNull(), "no_sample")
        .when(F.col("n_generations").isNull(), "no_generation")
        .otherwise("paired")
    )
    zero = F.lit(0).cast("long")
    return made.join(known, "task_id", "full_outer").select(
        "task_id",
        F.coalesce("n_generations", zero).alias("n_generations"),
        F.coalesce("n_samples", zero).alias("n_samples"),
        status.alias("status"),
    )
