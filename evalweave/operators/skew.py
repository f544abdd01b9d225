"""Joins, per-group limits and numbering that hold when one key has most rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave import scratch

# A table is sent to every executor only if its measured size is below this.
BROADCAST_BYTES = 32 * 1024 * 1024
# Otherwise it is copied once per salt, up to this much in all.
COPIES_BYTES = 64 * 1024**3
MAX_SALTS = 256
# A filter of wanted keys has so many bits, as powers of two.
MIN_FILTER_BITS = 16
MAX_FILTER_BITS = 27
# Rows that one copy of a wide row serves.
HOT_ROWS = 100_000
# Buckets of hashes in which the rows of groups are counted, and rows that one task numbers.
BUCKETS = 1 << 16
TASK_ROWS = 200_000
_SALT, _COPIES, _WORD, _PLACE, _BITS = "_salt", "_copies", "_word", "_place", "_bits"


def salts(spark: SparkSession, table_bytes: int = 0) -> int:
    """Salts to use: as many as shuffle partitions, fewer for a large table.

    Two are enough to keep later steps from relying on the join's partitioning,
    which is what lets adaptive execution split a skewed partition.
    """
    most = min(MAX_SALTS, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return max(2, min(most, COPIES_BYTES // max(1, table_bytes)))


def salt_of(count: int, *columns: str) -> Column:
    """A salt that a re-run of a lost task computes again."""
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def attach(
    big: DataFrame,
    per_key: DataFrame | scratch.Written,
    on: Sequence[str],
    spread: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Join ``big`` to a table with few rows per key (inner, left, left_semi or left_anti).

    ``per_key`` is written to shared storage, which measures it. A small one is
    broadcast, so ``big`` is not shuffled. Otherwise both sides are salted by
    ``spread``, columns of ``big`` that vary within a key: a key holding a third
    of all rows then becomes many shuffle partitions instead of one. Without
    ``spread``, for keys that are nearly unique in ``big``, the join is plain.
    """
    table = per_key if isinstance(per_key, scratch.Written) else scratch.write(per_key, "keys")
    if table.bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(table.df), list(on), how)
    if not spread:
        return big.join(table.df, list(on), how)
    count = salts(big.sparkSession, table.bytes)
    copies = table.df.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return (
        big.withColumn(_SALT, salt_of(count, *spread))
        .join(copies, [*on, _SALT], how)
        .drop(_SALT)
    )


def _bits(rows: int) -> int:
    """Bits of a filter for so many keys, as a power of two: sixteen for each, up to the bound."""
    return max(MIN_FILTER_BITS, min(MAX_FILTER_BITS, (16 * rows).bit_length()))


def sift(big: DataFrame, keys: scratch.Written, on: Sequence[str]) -> DataFrame:
    """``big`` without most rows whose key is not in ``keys``, dropped where they are read.

    A bitmap over hashes of the keys goes to every task, in words of 64 bits: at most
    ``2 ** MAX_FILTER_BITS`` bits, 16 bytes for each word that has any, so 32 MB. It loses no wanted row and
    lets a few others pass, ever more beyond its bound; a join after it is exact.
    """
    bits = _bits(keys.rows)

    def places(df: DataFrame) -> DataFrame:
        place = F.shiftrightunsigned(F.xxhash64(*on), 64 - bits)
        return df.withColumn(_WORD, F.shiftrightunsigned(place, 6)).withColumn(
            _PLACE, place.bitwiseAND(F.lit(63)).cast("int")
        )

    bit = F.expr(f"shiftleft(1L, {_PLACE})")
    words = places(keys.df.select(*on)).groupBy(_WORD).agg(F.bit_or(bit).alias(_BITS))
    found = places(big).join(F.broadcast(words), _WORD)
    return found.filter(F.getbit(_BITS, F.col(_PLACE)) == 1).select(*big.columns)


def fetch(big: DataFrame, keys: DataFrame | scratch.Written, on: Sequence[str]) -> DataFrame:
    """The rows of ``big`` whose key is in ``keys``, which has distinct keys and nothing else.

    For wide rows, such as texts: however many keys there are, ``big`` is sifted below
    the exchange. A small table of keys is broadcast, and nothing is exchanged.
    """
    table = keys if isinstance(keys, scratch.Written) else scratch.write(keys, "keys")
    if table.bytes > BROADCAST_BYTES:
        big = sift(big, table, on)
    # An inner join, as the optimizer moves a semi join below the sifting one.
    return attach(big, table, on).select(*big.columns)


def hot_keys(big: DataFrame, on: Sequence[str]) -> scratch.Written:
    """The keys of more than ``HOT_ROWS`` rows, with the copies that a row for each should have.

    There is at most one for every ``HOT_ROWS`` rows.
    """
    return counted_hot_keys(big.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")), on, "_rows")


def counted_hot_keys(counts: DataFrame, on: Sequence[str], rows: str) -> scratch.Written:
    """``hot_keys`` from the ``rows`` that each key is known to have."""
    copies = F.ceil(F.col(rows) / HOT_ROWS).cast("int").alias(_COPIES)
    return scratch.write(counts.filter(F.col(rows) > HOT_ROWS).select(*on, copies), "hot")


def spread(
    big: DataFrame,
    per_key: DataFrame | scratch.Written,
    on: Sequence[str],
    by: Sequence[str],
    hot: scratch.Written | None = None,
    how: str = "inner",
    hot_on: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``big`` (inner or left) to a table of one row per key that grows with it, or is wide.

    The row of a key in ``hot`` (``hot_keys`` of ``big``, if not given) is copied, and the
    rows of ``big`` are dealt among the copies by the columns ``by``. Other keys are not copied,
    unlike in ``attach``. A written table below the bound is broadcast. ``hot`` may be known by
    ``hot_on`` alone, some columns of the key: all keys that agree in them are then copied.
    """
    if isinstance(per_key, scratch.Written):
        if per_key.bytes <= BROADCAST_BYTES:
            return big.join(F.broadcast(per_key.df), list(on), how)
        per_key = per_key.df
    hot = hot_keys(big, on) if hot is None else hot
    if hot.rows == 0:
        return big.join(per_key, list(on), how)
    hot_on = on if hot_on is None else hot_on
    dealt = attach(big, hot, hot_on, by, "left")
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col(_COPIES)), F.lit(0)).cast("int")
    numbers = F.sequence(F.lit(0), F.coalesce(_COPIES, F.lit(1)) - 1)
    copied = attach(per_key, hot, hot_on, how="left").withColumn(_SALT, F.explode(numbers)).drop(_COPIES)
    return dealt.withColumn(_SALT, salt).drop(_COPIES).join(copied, [*on, _SALT], how).drop(_SALT)


def top_n(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, position: str
) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 0 in ``position``.

    Rows that are equal in ``order`` are one: they have one position and one of them
    is kept, so repeats are removed after the limit instead of by a shuffle below it.

    Spark limits each map partition to n ranks per group before the shuffle while
    n is below its threshold. Above it the limit is applied twice, first within
    salted slices of a group.
    """
    spark = df.sparkSession
    threshold = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        count = salts(spark)
        salted = df.withColumn(_SALT, salt_of(count, *[c for c in df.columns if c not in group]))
        slices = Window.partitionBy(*group, _SALT).orderBy(*order)
        df = (
            salted.withColumn(position, F.dense_rank().over(slices))
            .filter(F.col(position) <= n)
            .drop(position, _SALT)
        )
    ranked = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn(position, F.dense_rank().over(ranked))
        .filter(F.col(position) <= n)
        .withColumn(position, F.col(position) - 1)
        .dropDuplicates([*group, position])
    )


def global_index(df: DataFrame, order: Sequence[str], index: str) -> scratch.Written:
    """Number all rows from 0 in ``order`` without one task seeing them all.

    Rows are range-sorted and written with their partition-local id. Only the
    row count per partition, one row per task of the sort, is summed in order.
    """
    local = F.monotonically_increasing_id()
    sorted_rows = scratch.write(df.orderBy(*order).withColumn("_local", local), "sorted")
    placed = sorted_rows.df.withColumn("_part", F.shiftright("_local", 33)).withColumn(
        "_row", F.col("_local").bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0).cast("long")))
        .drop("_size")
    )
    numbered = (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(index, F.col("_offset") + F.col("_row"))
        .drop("_local", "_part", "_row", "_offset")
    )
    return scratch.Written(numbered, sorted_rows.rows, sorted_rows.bytes)


def index_within(df: DataFrame, group: Sequence[str], order: Sequence[str], index: str) -> DataFrame:
    """Number the rows of each group from 0 in ``order``; rows without a group are dropped.

    Rows are dealt by group to as many tasks as ``TASK_ROWS`` rows for each need, so a task's share
    does not grow with the table, and later steps by group exchange nothing. Rows are counted
    in buckets of groups first: groups of a bucket of more than ``HOT_ROWS`` rows are numbered by their places
    among all such rows, so that one with many rows is not sorted in one task.
    """
    known = df.dropna(subset=list(group))
    bucket = F.pmod(F.xxhash64(*group), F.lit(BUCKETS)).alias(_WORD)
    counts = scratch.store(known.groupBy(bucket).agg(F.count(F.lit(1)).alias("_rows")), "buckets")
    rows = counts.agg(F.sum("_rows").alias("rows")).first()["rows"] or 0
    hot = scratch.write(counts.filter(F.col("_rows") > HOT_ROWS).select(_WORD), "hot")
    few, many = known, None
    if hot.rows:
        placed = known.withColumn(_WORD, bucket)
        few = attach(placed, hot, [_WORD], how="left_anti").select(*df.columns)
        many = attach(placed, hot, [_WORD], how="left_semi").select(*df.columns)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    numbered = few.repartition(tasks, *group).withColumn(index, place.cast("long"))
    if many is None:
        return numbered
    placed = global_index(many, order, _PLACE).df
    first = placed.groupBy(*group).agg(F.min(_PLACE).alias("_first"))
    rest = attach(placed, first, group, [_PLACE]).withColumn(index, F.col(_PLACE) - F.col("_first"))
    return numbered.unionByName(rest.select(*numbered.columns))
