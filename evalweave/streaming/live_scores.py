"""Per-run scores while results still arrive.

Runs are judged one after the other and logged as they finish. Here judged
generations arrive as files of ``(task_id, gen_idx, verdicts)``, one row per
generation, and each trigger updates the scores of the tasks it touched. State
is one row of counters per task.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalweave.functions import passk
from evalweave.operators import scoring

RESULTS = "task_id bigint, gen_idx bigint, verdicts array<int>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RESULTS).parquet(path)


def live_scores(results: DataFrame) -> DataFrame:
    """pass@1 and normalised sum per task; works on streams and on tables."""
    totals = scoring.vector_totals(results)
    return totals.select(
        "task_id",
        "n",
        "c",
        passk.pass_at_k(F.col("n"), F.col("c"), F.lit(1)).alias("pass_at_1"),
        scoring.normalized_sum_value().alias("normalized_sum"),
    )


def start(results: DataFrame, checkpoint: str, log_path: str) -> StreamingQuery:
    """Append each trigger's updated scores to the run log, once per trigger."""

    def append(updated: DataFrame, trigger: int) -> None:
        # A trigger that is run again replaces its own folder.
        updated.write.mode("overwrite").parquet(f"{log_path}/trigger={trigger}")

    return (
        live_scores(results)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(append)
        .trigger(availableNow=True)
        .start()
    )


def latest_scores(spark: SparkSession, log_path: str) -> DataFrame:
    """Each task's scores after the last trigger that touched it."""
    log = spark.read.parquet(log_path)
    scores = [c for c in log.columns if c not in ("task_id", "trigger")]
    newest = F.max_by(F.struct(*scores), "trigger").alias("newest")
    return log.groupBy("task_id").agg(newest).select("task_id", "newest.*")
