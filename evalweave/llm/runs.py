"""Periodic runs of words, found in tiles by octave of the period.

A document is numbered word by word and cut, once per octave of periods, into
overlapping tiles around evenly spaced boundaries. Only tiles whose boundary block
occurs again one period later become rows; they are dealt over the cluster and each
is solved alone by Z-functions from its boundary, forwards and backwards. The
fragments are shuffled by document and period and stitched into maximal runs.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave import scratch

# A run has at least this many words and this many periods.
MIN_WORDS = 24
MIN_PERIODS = 3
# Boundaries of the first octave, whose periods are 1 to 15, are 8 words apart.
FIRST_OCTAVE = 3
# Bytes of a text turned into words at a time, cut at white space.
SPLIT_BYTES = 1 << 20
_TEXT_END = regex.compile(rb"[\x20\x09-\x0D]")
_MIX = np.uint64(0x9E3779B97F4A7C15)

RUN = "struct<start:long,length:long,period:long>"


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text`` in lists of about ``SPLIT_BYTES``."""
    begin = 0
    while begin < len(text):
        cut = _TEXT_END.search(text, begin + SPLIT_BYTES)
        end = cut.start() if cut else len(text)
        yield text[begin:end].split()  # of bytes: the six ASCII spaces only
        begin = end


def numbered(text: bytes) -> np.ndarray:
    """The words of ``text`` as numbers, equal where words are equal."""
    known: dict[bytes, int] = {}
    parts = [
        np.fromiter((known.setdefault(w, len(known)) for w in part), np.int32, len(part))
        for part in pieces(text)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * _MIX
    return values ^ (values >> np.uint64(29))


def open_tiles(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(octave, boundaries)`` of the tiles that may hold part of a run.

    A run with a period from 2^k matches itself, one period on, over two periods at
    least, so it covers a whole block of 2^k words after some boundary. Blocks are
    compared by hashes: no tile of a run is missed, and a chance hit is refused
    when its tile is solved.
    """
    n = len(ids)
    if n < MIN_WORDS:
        return
    hashes = _mixed(ids.astype(np.uint64) + np.uint64(1))
    for octave in range(n.bit_length()):
        span = 1 << octave
        if octave >= FIRST_OCTAVE:
            if MIN_PERIODS * span > n and octave > FIRST_OCTAVE:
                return
            places = -(-len(hashes) // span)
            table = np.zeros((places + 1, span), dtype=np.uint64)
            table.reshape(-1)[: len(hashes)] = hashes
            here = table[:-1, :1]
            hit = (here == table[1:]).any(axis=1)
            if octave == FIRST_OCTAVE:
                hit |= (here == table[:-1, 1:]).any(axis=1)
            found = np.flatnonzero(hit) * span
            if len(found):
                yield octave, found
        if len(hashes) <= span:
            return
        hashes = _mixed(hashes[:-span] * _MIX + hashes[span:])


def tile(ids: np.ndarray, octave: int, boundary: int) -> tuple[int, np.ndarray]:
    """The first word and the words of the tile around ``boundary``."""
    first = max(0, boundary - (1 << octave))
    return first, ids[first : boundary + (4 << octave)]


def z_function(values: list) -> list[int]:
    """For each place, how many values from there equal those from the start."""
    n = len(values)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        length = 0
        if i < right:
            length = z[i - left]
            if length < right - i:
                z[i] = length
                continue
            length = right - i
        while i + length < n and values[length] == values[i + length]:
            length += 1
        z[i] = length
        if i + length > right:
            left, right = i, i + length
    return z


def _prime_divisors(number: int) -> list[int]:
    found, divisor = [], 2
    while divisor * divisor <= number:
        if number % divisor == 0:
            found.append(divisor)
            while number % divisor == 0:
                number //= divisor
        divisor += 1
    return found + [number] * (number > 1)


def solve_tile(words: np.ndarray, before: int, octave: int) -> list[tuple[int, int, int]]:
    """``(period, low, high)``: words low to high - 1 of a tile equal those one period on.

    ``before`` is the place of the boundary in the tile. What is reported starts at
    most one block before the boundary and ends at most two after it, so fragments of
    neighbouring tiles touch. Periods that a shorter one explains are left out: the
    words of one period then repeat with a divisor of it, and so does the whole run.
    """
    span = 1 << octave
    values = words.tolist()
    ahead = z_function(values[before:])
    low_period = 1 if octave == FIRST_OCTAVE else span
    periods = [
        p
        for p in range(low_period, min(2 * span, len(ahead)))
        if ahead[p] >= span and not any(ahead[p // d] >= p - p // d for d in _prime_divisors(p))
    ]
    if not periods:
        return []
    pattern = values[:before][::-1]
    text = values[: before + 2 * span][::-1]
    back = z_function([*pattern, -1, *text])
    out = []
    for p in periods:
        # The text reversed: the place from which words before boundary + p run backwards.
        place = before + 1 + (len(text) - (before + p))
        out.append((p, before - min(back[place], before), before + min(ahead[p], 2 * span)))
    return out



def _searched(docs: DataFrame, finish: Callable[[list[bytes]], str]) -> DataFrame:
    """One ``row`` per document, and one per open tile of it, in one written table.

    Documents: ``doc_id``, ``n_words``, ``done`` (what ``finish`` makes of the words if no
    tile is open) or else ``text``. Tiles: ``octave``, ``first``, ``before`` and ``words``.
    """
    schema = pa.schema(
        [
            ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("done", pa.string()),
            ("text", pa.binary()), ("octave", pa.int32()), ("first", pa.int64()), ("before", pa.int32()),
            ("words", pa.binary()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                text = text.as_py() or b""
                ids, row, tiles = numbered(text), row + 1, 0
                for octave, boundaries in open_tiles(ids):
                    for boundary in boundaries.tolist():
                        first, words = tile(ids, octave, boundary)
                        packed = words.astype("<i4").tobytes()
                        out.append((row, None, None, None, None, octave, first, boundary - first, packed))
                        tiles, held = tiles + 1, held + len(packed)
                        if held > SPLIT_BYTES:
                            yield _batch(out, schema)
                            out, held = [], 0
                done = None if tiles else finish([w for part in pieces(text) for w in part])
                out.append((row, doc_id, len(ids), done, text if tiles else None, None, None, None, None))
            if out:
                yield _batch(out, schema)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work,
        "row long, doc_id long, n_words long, done string, text binary, "
        "octave int, first long, before int, words binary",
    )
    return scratch.store(found, "tiles")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _fragments(tiles: DataFrame) -> DataFrame:
    """``(row, period, low, high)`` of every tile, low and high in words of the document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, octave, first, before, words in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(words, "<i4")
                out += [(row, p, first + a, first + b) for p, a, b in solve_tile(values, before, octave)]
            if out:
                names = ["row", "period", "low", "high"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    dealt = tiles.select("row", "octave", "first", "before", "words").repartition("row", "octave", "first")
    return dealt.mapInArrow(work, "row long, period long, low long, high long")


def _stitched(fragments: DataFrame) -> DataFrame:
    """``(row, start, length, period)`` of the runs that touching fragments make up."""
    key = Window.partitionBy("row", "period")
    order = key.orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("low") > F.coalesce(reached, F.lit(-1)), 1).otherwise(0)
    islands = fragments.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order))
    length = (F.max("high") + F.col("period") - F.min("low")).alias("length")
    return (
        islands.groupBy("row", "period", "island")
        .agg(F.min("low").alias("start"), length)
        .filter((F.col("length") >= MIN_WORDS) & (F.col("length") >= MIN_PERIODS * F.col("period")))
        .select("row", "start", "length", "period")
    )


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those inside a run and after its first period."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def joined(words: list[bytes]) -> str:
    return b" ".join(words).decode()


def collapse(docs: DataFrame, finish: Callable[[list[bytes]], str] = joined) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row of ``docs(doc_id, text)``.

    ``runs`` lists ``(start, length, period)`` by start, then period: maximal stretches
    of words that repeat with that smallest period, of ``MIN_WORDS`` words and
    ``MIN_PERIODS`` periods at least. ``collapsed`` is what ``finish`` makes of the words
    left when each run keeps its first period (by default, the words joined by a space).

    A null text counts as empty: no words, no runs, an empty ``collapsed``. Rows are told
    apart by a written number, so repeated rows and null or repeated ids stay as they are.
    Runs with equal start are ordered by period. A very long text is split in pieces and its
    tiles are solved by many tasks. Other columns are not read; no rows give no rows.
    """
    table = _searched(docs, finish)
    documents = table.filter("n_words is not null").select("row", "doc_id", "n_words", "done", "text")
    found = _stitched(_fragments(table.filter("octave is not null")))
    per_row = found.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs")
    )
    wanted = documents.filter("text is not null").join(per_row, "row", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = [w for part in pieces(text) for w in part]
                ends.append(finish(kept_words(words, [tuple(r.values()) for r in runs or ()])))
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(ends, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    none = F.array().cast(f"array<{RUN}>")
    schema = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
    ended = wanted.select("doc_id", "n_words", "text", F.coalesce("runs", none).alias("runs")).mapInArrow(work, schema)
    plain = documents.filter("text is null").select(
        "doc_id", "n_words", none.alias("runs"), F.col("done").alias("collapsed")
    )
    return plain.unionAll(ended)


def digests(docs: DataFrame) -> DataFrame:
    """The strongest run of each row and digests of all its runs and its collapsed words.

    Greatest length over period first, compared without rounding; ties go to the smallest
    start, then period. Rows are treated as by :func:`collapse`.
    """
    found = collapse(docs, lambda words: hashlib.sha256(b" ".join(words)).hexdigest())
    best = F.reduce(
        "runs",
        F.lit(None).cast(RUN),
        lambda top, r: F.when(
            top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r
        ).otherwise(top),
    )
    listed = F.array_join(
        F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), ""
    )
    top = F.col("top")
    return found.withColumn("top", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )
