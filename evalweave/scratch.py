"""Tables written to the cluster's shared folder to cut lineage.

The folder is the session's ``spark.checkpoint.dir``. Only a single-machine
session may go without it; it then gets a fresh temporary folder.
"""

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"
# Width of a number, date or flag in a row; decimals of over 18 digits take two.
FIXED_BYTES = 8


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="evalweave-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/evalweave/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Written:
    """A table on shared storage, with the size measured while it was written."""

    df: DataFrame
    rows: int
    bytes: int
    largest: int = 0


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, for plans that read it more than once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(field: T.StructField) -> Column:
    """Bytes of a value: texts and arrays of numbers by length, other nested values as JSON."""
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * FIXED_BYTES
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(column)))
    wide = isinstance(kind, T.DecimalType) and kind.precision > 18
    return F.lit(2 * FIXED_BYTES if wide else FIXED_BYTES)


def write(df: DataFrame, name: str, largest: str | None = None) -> Written:
    """Store ``df`` and measure it in the same job, also column ``largest``'s maximum."""
    seen = Observation()
    maximum = F.lit(0) if largest is None else F.col(largest)
    width = sum((_width(field).cast("long") for field in df.schema), F.lit(0).cast("long"))
    measured = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.sum(width).alias("bytes"),
        F.max(maximum).alias("largest"),
    )
    stored = store(measured, name)
    size = seen.get
    return Written(stored, size["rows"], size["bytes"] or 0, size["largest"] or 0)
