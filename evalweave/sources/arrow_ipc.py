"""Arrow IPC files as a Spark data source, read and written.

``spark.dataSource.register(ArrowIpc)``, then ``format("arrow_ipc")``. A file is
read in ranges of record batches, a stream whole. Only the columns of the given
schema are taken from each batch. With option ``position`` the rows also carry
``file_name`` and ``file_pos``, so that "first row of the file" has a meaning.

Files written here hold the least and greatest value of each column and batch beside
their schema. A filter on the rows then skips the batches that no row of it can be in;
Spark applies it again to what is read. Footers are read by the tasks that need them.
"""

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import LongType, StringType, StructType

from evalweave.operators import skew

# Workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 128 * 1024 * 1024
# Bytes of batches that a written file holds at most, and a writing task in memory.
FILE_BYTES = 64 * 1024 * 1024
# Texts longer than this have no statistics.
STATED_LETTERS = 64
FILE_NAME = "file_name"
FILE_POS = "file_pos"
_STATISTICS = b"evalweave.statistics"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path within it."""
    if path.startswith("s3a://"):
        path = "s3://" + path[len("s3a://") :]
    elif "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def _is_file_format(fs: pafs.FileSystem, path: str) -> bool:
    with fs.open_input_file(path) as f:
        return f.read(6) == b"ARROW1"


def _data_files(path: str) -> list[pafs.FileInfo]:
    fs, root = _open(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [info]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    files = [
        f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))
    ]
    return sorted(files, key=lambda f: f.path)


def _bounds(column: pa.Array) -> tuple | None:
    """Least and greatest value as JSON can hold them; None where there are none to rely on."""
    kind = column.type
    if pa.types.is_date32(kind):
        column, kind = column.cast(pa.int32()), pa.int32()
    if pa.types.is_integer(kind):
        found = pc.min_max(column).as_py()
    elif pa.types.is_string(kind):
        found = pc.min_max(column).as_py()
        if any(v is not None and len(v) > STATED_LETTERS for v in found.values()):
            return None
    elif pa.types.is_floating(kind):
        # Not-a-number is above all numbers in Spark, and in no order here.
        if pc.any(pc.is_nan(column)).as_py():
            return None
        found = pc.min_max(column).as_py()
    else:
        return None
    return found["min"], found["max"]


def statistics(batch: pa.RecordBatch) -> dict[str, list]:
    """Per column ``[least, greatest, nulls, rows]``, the first two null if not known."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        bounds = _bounds(column)
        if bounds is not None:
            out[name] = [*bounds, column.null_count, batch.num_rows]
    return out


def _plain(value):
    """A filter's value as the statistics hold it."""
    import datetime

    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return (value - datetime.date(1970, 1, 1)).days
    return value


def may_hold(known: dict[str, list], wanted: Filter) -> bool:
    """Whether a batch of these statistics can have a row that passes the filter."""
    name = ".".join(getattr(wanted, "attribute", ()))
    if name not in known:
        return True
    least, greatest, nulls, rows = known[name]
    if isinstance(wanted, IsNull):
        return nulls > 0
    if isinstance(wanted, IsNotNull):
        return nulls < rows
    value = getattr(wanted, "value", None)
    values = [_plain(v) for v in value] if isinstance(wanted, In) else [_plain(value)]
    kind = str if isinstance(least, str) else (int, float)
    if not isinstance(wanted, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith)):
        return True
    if nulls == rows:
        return False
    if any(not isinstance(v, kind) or isinstance(v, bool) for v in values):
        return True
    if isinstance(wanted, (EqualTo, In)):
        return any(least <= v <= greatest for v in values)
    (limit,) = values
    if isinstance(wanted, StringStartsWith):
        return least[: len(limit)] <= limit <= greatest or greatest.startswith(limit)
    return {
        GreaterThan: greatest > limit,
        GreaterThanOrEqual: greatest >= limit,
        LessThan: least < limit,
        LessThanOrEqual: least <= limit,
    }[type(wanted)]


@dataclass
class FilePart:
    """One of ``parts`` equal shares of a file's record batches."""

    path: str
    part: int
    parts: int


@dataclass
class FileParts(InputPartition):
    files: list[FilePart]


class ArrowIpcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path = path
        self.names = schema.names
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        """All are applied again to the rows; here they rule out record batches."""
        self.filters = list(filters)
        return self.filters

    def partitions(self) -> list[FileParts]:
        """Shares of large files, small files together, by size alone: no file is opened."""
        plans: list[FileParts] = []
        held, size = [], 0
        for f in _data_files(self.path):
            parts = -(-f.size // SPLIT_BYTES)
            if parts > 1:
                plans += [FileParts([FilePart(f.path, i, parts)]) for i in range(parts)]
                continue
            if held and size + f.size > SPLIT_BYTES:
                plans.append(FileParts(held))
                held, size = [], 0
            held.append(FilePart(f.path, 0, 1))
            size += f.size
        return [*plans, FileParts(held)] if held or not plans else plans

    def read(self, partition: FileParts) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        # Without a schema the file's own columns are read; see ArrowIpc.schema.
        plain = [n for n in self.names if n not in (FILE_NAME, FILE_POS)]
        for share in partition.files:
            if _is_file_format(fs, share.path):
                yield from self._read_file(fs, share, plain)
            elif share.part == 0:
                with fs.open_input_stream(share.path) as source:
                    for i, batch in enumerate(ipc.open_stream(source)):
                        yield self._shape(batch, plain, share.path, i)

    def _read_file(self, fs: pafs.FileSystem, share: FilePart, plain: list[str]) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(share.path) as source:
            reader = ipc.open_file(source)
            wanted = [reader.schema.get_field_index(n) for n in plain]
            places = self.wanted_batches(reader, share)
            options = ipc.IpcReadOptions(included_fields=sorted(wanted))
            reader = ipc.open_file(source, options=options)
            for i in places:
                yield self._shape(reader.get_batch(i), plain, share.path, i)

    def wanted_batches(self, reader: ipc.RecordBatchFileReader, share: FilePart) -> list[int]:
        """The share's record batches that can have a row for all filters."""
        n = reader.num_record_batches
        places = range(n * share.part // share.parts, n * (share.part + 1) // share.parts)
        known = json.loads((reader.schema.metadata or {}).get(_STATISTICS, b"[]"))
        if len(known) != n:
            return list(places)
        return [i for i in places if all(may_hold(known[i], f) for f in self.filters)]

    def _shape(self, batch: pa.RecordBatch, plain: list[str], path: str, i: int) -> pa.RecordBatch:
        columns = {n: batch.column(batch.schema.get_field_index(n)) for n in plain}
        if FILE_NAME in self.names:
            columns[FILE_NAME] = pa.array([path] * batch.num_rows, pa.string())
        if FILE_POS in self.names:
            first = i << 32
            columns[FILE_POS] = pa.array(np.arange(first, first + batch.num_rows))
        return pa.RecordBatch.from_arrays([columns[n] for n in self.names], self.names)


@dataclass
class WrittenFiles(WriterCommitMessage):
    """Staged files of a task and the names they get."""

    files: list[tuple[str, str]]


class ArrowIpcWriter(DataSourceArrowWriter):
    """Each task stages files of at most ``FILE_BYTES``; committing the job renames them.

    A task that is run again stages other files, which the commit ignores.
    """

    def __init__(self, path: str, overwrite: bool):
        fs, root = _open(path)
        if overwrite:
            raise ValueError("arrow_ipc only appends; write to a new folder")
        fs.create_dir(root)
        self.path = path
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        from pyspark import TaskContext

        fs, root = _open(self.path)
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        files: list[tuple[str, str]] = []

        def stage(batches: list[pa.RecordBatch]) -> None:
            known = json.dumps([statistics(b) for b in batches]).encode()
            schema = batches[0].schema
            schema = schema.with_metadata({**(schema.metadata or {}), _STATISTICS: known})
            staged = f"{root}/_staged-{uuid.uuid4().hex}"
            with fs.open_output_stream(staged) as sink, ipc.new_file(sink, schema) as writer:
                for batch in batches:
                    writer.write_batch(batch.replace_schema_metadata(schema.metadata))
            files.append((staged, f"{root}/part-{task:05d}-{len(files):05d}-{self.job}.arrow"))

        held, size = [], 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if held and size + batch.nbytes > FILE_BYTES:
                stage(held)
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            stage(held)
        return WrittenFiles(files)

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        fs, _ = _open(self.path)
        for message in filter(None, messages):
            for staged, final in message.files:
                fs.move(staged, final)

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        fs, _ = _open(self.path)
        for message in filter(None, messages):
            for staged, _ in message.files:
                fs.delete_file(staged)


class ArrowIpc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        """The schema of the first file, from its first bytes, plus the position columns if asked for."""
        from pyspark.sql.pandas.types import from_arrow_schema

        path = self.options["path"]
        files = _data_files(path)
        if not files:
            raise FileNotFoundError(f"no Arrow files in {path}")
        fs, _ = _open(path)
        with fs.open_input_stream(files[0].path) as source:
            # A file is a stream between a mark of 8 bytes and a footer.
            if _is_file_format(fs, files[0].path):
                source.read(8)
            found = from_arrow_schema(ipc.open_stream(source).schema)
        if self.options.get("position", "false").lower() == "true":
            found = found.add(FILE_NAME, StringType()).add(FILE_POS, LongType())
        return found

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowIpcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrowIpcWriter(self.options["path"], overwrite)


def read_arrow(
    spark: SparkSession, path: str, schema: StructType | str | None = None, position: bool = False
) -> DataFrame:
    spark.dataSource.register(ArrowIpc)
    spark.conf.set(_PUSHDOWN, "true")
    reader = spark.read.format("arrow_ipc").option("position", str(position).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def number_rows(df: DataFrame, column: str = "id") -> DataFrame:
    """Rows of ``read_arrow(position=True)`` numbered from 0 over all files in name order.

    For data sets whose ids are row positions. Only row counts per record batch
    are added up, within each file and then over one row per file.
    """
    batch = F.shiftright(FILE_POS, 32).alias("_batch")
    batches = df.groupBy(FILE_NAME, batch).agg(F.count(F.lit(1)).alias("_rows"))
    within = Window.partitionBy(FILE_NAME).orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)
    files = batches.groupBy(FILE_NAME).agg(F.sum("_rows").alias("_size"))
    over_files = Window.orderBy(FILE_NAME).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = batches.select(
        FILE_NAME, "_batch", F.coalesce(F.sum("_rows").over(within), zero).alias("_in_file")
    ).join(
        files.select(FILE_NAME, F.coalesce(F.sum("_size").over(over_files), zero).alias("_before")),
        FILE_NAME,
    )
    first = starts.select(FILE_NAME, "_batch", (F.col("_before") + F.col("_in_file")).alias("_first"))
    row = F.col(FILE_POS).bitwiseAND(F.lit((1 << 32) - 1))
    return (
        skew.attach(df.withColumn("_batch", batch), first, [FILE_NAME, "_batch"])
        .withColumn(column, F.col("_first") + row)
        .drop("_batch", "_first", FILE_NAME, FILE_POS)
    )


def write_arrow(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(ArrowIpc)
    df.write.format("arrow_ipc").mode("append").save(path)
