"""JSON documents written by many tasks, one file each however large.

A row is one value of a document: the ``file`` it goes to, the ``path`` of keys to the list that
holds it, and the ``value`` as JSON; a null, alone on its path, leaves the list empty. ``head`` and
``tail`` are text around the lists, taken from the file's first and last row. Rows come sorted, so a
task writes what it has of a file as it comes, and nothing is gathered by file. Files within one task are
finished there; those that go on in the next task are joined, in order, by the commit.
"""

import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from evalweave.sources import arrow_ipc

# Workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ("file", "head", "tail", "path", "value")
COPY_BYTES = 1 << 20

Path = tuple[str, ...]


def opening(path: Path, depth: int = 0) -> str:
    """Text from the object at ``depth`` of ``path`` to the start of its list."""
    import json

    keys = [json.dumps(key, ensure_ascii=False) + ":" for key in path[depth:]]
    return "{".join(keys) + "["


def between(last: Path | None, path: Path | None) -> str:
    """Text between a value, or the document's start, and the next one, or its end."""
    if last is None:
        return ("{" if path else "") + opening(path)
    if path is None:
        return "]" + "}" * len(last)
    if last == path:
        return ","
    depth = 0
    while depth < min(len(last), len(path)) and last[depth] == path[depth]:
        depth += 1
    if depth in (len(last), len(path)):
        raise ValueError(f"{last} and {path} cannot be in one document")
    return "]" + "}" * (len(last) - 1 - depth) + "," + opening(path, depth)


@dataclass
class Segment:
    """A staged part of a document. If it is the first of its task, what stands before its
    first value is left to the commit; unless it is whole, so is what stands after its last."""

    file: str
    staged: str
    head: str
    tail: str
    first: Path
    last: Path
    started: bool
    whole: bool = False


@dataclass
class Segments(WriterCommitMessage):
    task: int
    segments: list[Segment] = field(default_factory=list)


class JsonFilesWriter(DataSourceArrowWriter):
    """Stages segments; committing the job renames whole documents and joins the others."""

    def __init__(self, path: str, overwrite: bool):
        if overwrite:
            raise ValueError("json_files only appends; write to a new folder")
        fs, root = arrow_ipc._open(path)
        fs.create_dir(root)
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segments:
        from pyspark import TaskContext

        fs, root = arrow_ipc._open(self.path)
        context = TaskContext.get()
        out = Segments(context.partitionId() if context else 0)
        sink, segment, was_null = None, None, False
        for batch in iterator:
            for file, head, tail, path, value in zip(*(c.to_pylist() for c in batch.columns)):
                path = tuple(path)
                if segment is None or file != segment.file:
                    if segment is not None:
                        # The first of a task may have begun in another, those between are whole.
                        if segment.started:
                            sink.write((between(segment.last, None) + segment.tail).encode())
                            segment.whole = True
                        sink.close()
                    staged = f"{root}/_staged-{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(staged)
                    segment = Segment(file, staged, head or "", "", path, path, bool(out.segments))
                    if segment.started:
                        sink.write((segment.head + between(None, path)).encode())
                    out.segments.append(segment)
                else:
                    if path == segment.last and (was_null or value is None):
                        raise ValueError(f"{path} has values and none")
                    sink.write(between(segment.last, path).encode())
                if value is not None:
                    sink.write(value.encode())
                segment.last, segment.tail, was_null = path, tail or "", value is None
        if sink is not None:
            sink.close()
        return out

    def commit(self, messages: list[Segments | None]) -> None:
        fs, root = arrow_ipc._open(self.path)
        shared: dict[str, list[Segment]] = {}
        for message in sorted(filter(None, messages), key=lambda m: m.task):
            for segment in message.segments:
                if segment.whole:
                    fs.move(segment.staged, f"{root}/{segment.file}")
                else:
                    shared.setdefault(segment.file, []).append(segment)
        for file, segments in shared.items():
            composed = f"{root}/_joined-{uuid.uuid4().hex}"
            with fs.open_output_stream(composed) as sink:
                last = None
                for segment in segments:
                    if not segment.started:
                        head = segment.head if last is None else ""
                        sink.write((head + between(last, segment.first)).encode())
                    with fs.open_input_stream(segment.staged) as source:
                        while piece := source.read(COPY_BYTES):
                            sink.write(piece)
                    last = segment.last
                sink.write((between(last, None) + segments[-1].tail).encode())
            fs.move(composed, f"{root}/{file}")
            for segment in segments:
                fs.delete_file(segment.staged)

    def abort(self, messages: list[Segments | None]) -> None:
        fs, _ = arrow_ipc._open(self.path)
        for message in filter(None, messages):
            for segment in message.segments:
                fs.delete_file(segment.staged)


class JsonFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_files"

    def schema(self) -> StructType:
        return StructType.fromDDL("file string, head string, tail string, path array<string>, value string")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return JsonFilesWriter(self.options["path"], overwrite)


def write(values: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """Write rows of ``COLUMNS`` to one file per ``file``, the values of a file in ``order``.

    Rows are dealt by ranges of file and order: a file of very many rows is written by several tasks.
    """
    values.sparkSession.dataSource.register(JsonFiles)
    keys = [F.col("file"), *[F.col(c) if isinstance(c, str) else c for c in order]]
    dealt = values.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.select(*COLUMNS).write.format("json_files").mode("append").save(path)
