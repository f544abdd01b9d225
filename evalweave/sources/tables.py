"""Parquet tables with declared schemas, stored verdicts, and the run log."""

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from evalweave import schemas, scratch


def _read(
    spark: SparkSession, path: str, schema: StructType, names: Mapping[str, str] | None
) -> DataFrame:
    """Scan with the declared types; ``names`` maps our columns to the file's.

    Renaming in the scan's projection keeps pruning and pushed filters.
    """
    stored = dict(names or {})
    fields = [StructField(stored.get(f.name, f.name), f.dataType) for f in schema]
    rows = spark.read.schema(StructType(fields)).parquet(path)
    return rows.select(*[F.col(stored.get(n, n)).alias(n) for n in schema.names])


def read_problems(
    spark: SparkSession, path: str, names: Mapping[str, str] | None = None
) -> DataFrame:
    return _read(spark, path, schemas.PROBLEMS, names)


def read_solutions(
    spark: SparkSession, path: str, names: Mapping[str, str] | None = None
) -> DataFrame:
    return _read(spark, path, schemas.SOLUTIONS, names)


def read_tests(spark: SparkSession, path: str, problem_id: int | None = None) -> DataFrame:
    """Evaluation tests; a single problem's filter reaches the scan."""
    tests = spark.read.schema(schemas.EVALUATION_TESTS).parquet(path)
    return tests if problem_id is None else tests.filter(F.col("id") == problem_id)


def read_raw_samples(
    spark: SparkSession, path: str, names: Mapping[str, str] | None = None
) -> DataFrame:
    return _read(spark, path, schemas.RAW_SAMPLES, names)


def append_runs(runs: DataFrame, path: str) -> DataFrame:
    """Append run results to the log and return the log."""
    runs.write.mode("append").parquet(path)
    return runs.sparkSession.read.schema(runs.schema).parquet(path)


# Parts of the run log; logging some runs rewrites the parts they are in.
LOG_PARTS = 64
_PART = "run_part"


def log_runs(runs: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Log runs, each in place of what was logged for its ``key`` before, and return the log.

    The log is cut into ``LOG_PARTS`` by a hash of the key. Only the parts of the new runs are
    written again, all at once, so logging a run twice, or again after a failure, leaves one row.
    """
    spark = runs.sparkSession
    parted = runs.withColumn(_PART, F.pmod(F.xxhash64(*key), F.lit(LOG_PARTS)).cast("int"))
    fresh = scratch.store(parted, "logged")
    schema = fresh.schema
    touched = [r[0] for r in fresh.select(_PART).distinct().collect()]  # LOG_PARTS rows at most
    if _exists(spark, path):
        old = spark.read.schema(schema).parquet(path).filter(F.col(_PART).isin(touched))
        kept = old.join(fresh.select(*key).distinct(), list(key), "left_anti").select(fresh.columns)
        fresh = scratch.store(fresh.unionByName(kept), "merged")
    writer = fresh.repartition(_PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(_PART).parquet(path)
    return spark.read.schema(schema).parquet(path).drop(_PART)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there, as Spark's own readers see it."""
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").head(1))
    except AnalysisException:
        return False


def write_verdicts(
    verdicts: DataFrame, path: str, by: Sequence[str] = (), buckets: int | None = None
) -> None:
    """Store verdicts by treatment, so that a report on one prunes the others.

    With ``by``, the columns of a run, they are stored for ``read_verdicts`` in ``buckets`` of one
    generation's verdicts together, sorted.
    """
    if not by:
        verdicts.write.partitionBy("context_type").parquet(path)
        return
    key = [*by, "gen_idx"]
    count = buckets or int(verdicts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = _table(path)
    dealt = verdicts.repartition(count, *key)
    writer = dealt.write.format("parquet").bucketBy(count, *key).sortBy(*key).option("path", path)
    writer.saveAsTable(name)


def _table(path: str) -> str:
    """A catalog name for the table of a path."""
    return "verdicts_" + hashlib.md5(path.encode()).hexdigest()


def read_verdicts(spark: SparkSession, path: str, schema: StructType, by: Sequence[str], buckets: int) -> DataFrame:
    """Verdicts as ``write_verdicts`` stored them with ``by``: aggregated per generation without a shuffle.

    A session that did not write them enters the table in its catalog first.
    """
    name, key = _table(path), [*by, "gen_idx"]
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        listed = ", ".join(f"`{k}`" for k in key)
        spark.sql(
            f"create table {name} ({columns}) using parquet clustered by ({listed}) sorted by ({listed}) "
            f"into {buckets} buckets location '{path}'"
        )
    return spark.table(name)
