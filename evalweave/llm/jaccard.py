"""Similarity join of documents on the Jaccard index of their word n-grams.

The n-grams of a document are put in one order for the whole corpus, rare first. If
two sets are similar enough, their prefixes in that order share an n-gram, so
candidates come from a join on prefix n-grams; the sizes of the sets, the places of the
shared n-gram and the make-up of what follows it refuse most of them before the
n-grams themselves are compared, once per pair.

The order is by counts in a table of hash buckets of fixed size, over all documents:
common n-grams stand out of it at any corpus size, and any order gives the same links.
"""

import re
from collections.abc import Iterator, Sequence
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave import scratch
from evalweave.llm import components
from evalweave.operators import skew

SHINGLE_WORDS = 3
# Sets link if their intersection is at least so many hundredths of their union.
PERCENT = 90
# Buckets that n-grams are counted in, as a power of two: 4 MB sent to every task.
SKETCH_BITS = 20
# How many of a block's documents all others are compared with, before the rest is.
STAR_ROUNDS = 2
# Bytes of text hashed at a time.
BUFFER_BYTES = 1 << 18
LANES = 16
_HIGH = np.uint64(64 - SKETCH_BITS)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOW = np.uint64((1 << SKETCH_BITS) - 1)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _SECOND
    return values ^ (values >> np.uint64(29))


_BLANK = b" \t\n\r\x0b\x0c"
_SPACES = np.isin(np.arange(256), list(_BLANK))
# A word's hash is the sum of its letters' numbers, each times a power by its place.
_LETTERS = np.array([xxhash.xxh64_intdigest(bytes([b]).lower()) for b in range(256)], dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(base: int) -> np.ndarray:
    powers = np.full(BUFFER_BYTES + 2, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _buffers(text: bytes) -> Iterator[bytes]:
    """``text`` cut at white space into parts of at most ``BUFFER_BYTES``, but for longer words."""
    begin = 0
    while len(text) - begin > BUFFER_BYTES:
        spaces = np.flatnonzero(_SPACES[np.frombuffer(text, np.uint8, BUFFER_BYTES, begin)])
        if len(spaces):
            end = begin + int(spaces[-1]) + 1
        else:
            following = _SPACE.search(text, begin)
            end = following.end() if following else len(text)
        yield text[begin:end].strip(_BLANK)
        begin = end
    yield text[begin:].strip(_BLANK)


def _hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of ``texts`` in order, A-Z lower-cased, and how many each text has.

    Together the texts fit a buffer, or they are one longer word.
    """
    whole = b"\n".join(texts) + b"\n"
    if len(whole) > BUFFER_BYTES + 1:
        return np.array([xxhash.xxh64_intdigest(texts[0].lower())], np.uint64), np.ones(1, np.int64)
    letters = np.frombuffer(whole, np.uint8)
    space = _SPACES[letters]
    edges = np.diff(space, prepend=True)
    edges = np.flatnonzero(edges)
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[letters] * _powers(_BASE)[: len(letters)])))
    hashes = (sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64))[starts]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return _mixed(hashes), np.diff(np.searchsorted(starts, text_ends), prepend=0)


def _words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_hashed_words`` of some texts at a time; a text longer than a buffer comes alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) >= BUFFER_BYTES:
            yield _hashed_words(held)
            held, size = [], 0
        if len(text) >= BUFFER_BYTES:
            parts = np.concatenate([_hashed_words([part])[0] for part in _buffers(text)])
            yield parts, np.array([len(parts)])
        else:
            held.append(text)
            size += len(text) + 1
    if held:
        yield _hashed_words(held)


def shingles(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its n-grams, lower-cased in A-Z.

    With fewer than ``size`` words there is one, of all words; without words none.
    """
    for words, counts in _words(texts):
        grams = {}
        for length in {min(size, n) for n in counts.tolist()} - {0}:
            many = len(words) - length + 1
            hashes = np.full(many, length, dtype=np.uint64)
            for i in range(length):
                hashes = _mixed(hashes * np.uint64(_BASE) + words[i : i + many])
            grams[length] = hashes
        begin = 0
        for n in counts.tolist():
            length = min(size, n)
            yield np.unique(grams[length][begin : begin + n - length + 1]) if n else words[:0]
            begin += n


def _marked(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, mark)``, ``mark`` a hash of id and text by which a row is found again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("mark", F.xxhash64(F.lit(1), "doc_id", "text"))


def _hashed(rows: DataFrame, size: int, work, schema: str) -> DataFrame:
    """``work(batches)`` over ``_marked`` rows, each batch as ``[(doc_id, set's id, n-grams, mark)]``.

    Equal sets have one id, a 64-bit hash; empty sets have none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            out = []
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc_id, grams, mark in zip(ids, shingles(texts, size), marks):
                doc = xxhash.xxh3_64_intdigest(grams.tobytes()) if len(grams) else None
                out.append((doc_id, None if doc is None else doc - (1 << 63), grams, mark))
            yield out

    return rows.mapInArrow(lambda batches: work(read(batches)), schema)


def _fresh(rows: list, seen: set[int]) -> list:
    """The rows whose set the task has not met before."""
    out = []
    for row in rows:
        if row[1] is not None and row[1] not in seen:
            seen.add(row[1])
            out.append(row)
    return out


def _batch(columns: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def members(docs: DataFrame, size: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, doc, n, mark)`` per row, ``doc`` the id of its set; and ``(bucket, count)``.

    The counts are of all n-grams of the corpus, one for each set a task holds.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("mark", pa.int64())]
        + [("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
    )

    def work(batches: Iterator[list]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(1 << SKETCH_BITS, dtype=np.int64), set()
        for rows in batches:
            fresh = [row[2] & _LOW for row in _fresh(rows, seen)]
            if fresh:
                sketch += np.bincount(np.concatenate(fresh).astype(np.int64), minlength=len(sketch))
            if rows:
                ids, sets, grams, marks = zip(*rows)
                yield _batch((ids, sets, [len(g) for g in grams], marks, *[[None] * len(rows)] * 2), schema)
        used = np.flatnonzero(sketch)
        if len(used):
            yield _batch(([None], [None], [None], [None], [used], [sketch[used]]), schema)

    ddl = "doc_id long, doc long, n long, mark long, buckets array<int>, counts array<long>"
    table = scratch.store(_hashed(_marked(docs), size, work, ddl), "members")
    parts = table.filter("buckets is not null").select(
        F.explode(F.arrays_zip("buckets", "counts")).alias("part")
    )
    sketch = parts.groupBy(F.col("part.buckets").alias("bucket")).agg(F.sum("part.counts").alias("count"))
    return table.filter("n is not null").select("doc_id", "doc", "n", "mark"), sketch


def ranks(sketch: DataFrame) -> np.ndarray:
    """The place of each bucket, those of rare n-grams first."""
    found = sketch.toArrow()  # as many rows as there are buckets, at most
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("count").to_numpy()
    places = np.empty(len(counts), dtype=np.uint32)
    places[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    return places


def ordered(grams: np.ndarray, places: np.ndarray) -> np.ndarray:
    """N-grams as numbers that sort in the corpus order; distinct ones stay distinct."""
    rank = places[(grams & _LOW).astype(np.int64)].astype(np.uint64)
    return np.sort((rank << _HIGH) | (grams >> np.uint64(SKETCH_BITS)))


def least_shared(percent: int, sizes: Column) -> Column:
    """The smallest intersection of two linked sets whose sizes add up to ``sizes``."""
    return F.ceil(percent * sizes / F.lit(100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _packed(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sixteen counters a row, modulo 256, in two longs."""
    both = np.ascontiguousarray(lanes.astype(np.uint8)).view("<i8")
    return both[:, 0], both[:, 1]


def prefixes(docs: DataFrame, places, size: int, percent: int) -> DataFrame:
    """``(token, doc, n, pos, near, far)``: the prefix n-grams of every set.

    ``near`` and ``far`` count what follows in the set, in sixteen classes of n-grams.
    """
    schema = pa.schema(
        [("token", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())]
        + [("near", pa.int64()), ("far", pa.int64())]
    )

    def work(batches: Iterator[list]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for rows in batches:
            out = []
            for _, doc, grams, _ in _fresh(rows, seen):
                keys, n = ordered(grams, places.value), len(grams)
                head = prefix_size(n, percent)
                lane = (keys & np.uint64(LANES - 1)).astype(np.int64)
                passed = np.cumsum(lane[:head, None] == np.arange(LANES), axis=0)
                out.append((keys[:head].view(np.int64), doc, n, np.bincount(lane, minlength=LANES) - passed))
            if out:
                tokens, sets, sizes, lanes = zip(*out)
                heads = [len(t) for t in tokens]
                places_in = np.concatenate([np.arange(h) for h in heads])
                columns = (np.concatenate(tokens), np.repeat(sets, heads), np.repeat(sizes, heads), places_in)
                yield _batch((*columns, *_packed(np.concatenate(lanes))), schema)

    return _hashed(_marked(docs), size, work, "token long, doc long, n int, pos int, near long, far long")


def blocks(docs: DataFrame, places, size: int, percent: int) -> DataFrame:
    """The rows of :func:`prefixes` whose n-gram occurs in another row."""
    table = scratch.store(prefixes(docs, places, size, percent), "prefixes")
    shared = table.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("token")
    return scratch.store(skew.fetch(table, shared, ["token"]), "blocks")


def _apart(x: Column, y: Column) -> Column:
    """Sum over eight counters of how far apart they are, at the least."""
    total = F.lit(0)
    for lane in range(8):
        of_x, of_y = (F.shiftrightunsigned(c, 8 * lane).bitwiseAND(F.lit(255)) for c in (x, y))
        gap = F.abs(of_x - of_y)
        total = total + F.least(gap, 256 - gap)
    return total


def may_link(percent: int) -> Column:
    """Length, positional and suffix filter for rows ``x`` and ``y`` of one block."""
    nx, ny, px, py = (F.col(c).cast("long") for c in ("x.n", "y.n", "x.pos", "y.pos"))
    shared = least_shared(percent, nx + ny)
    long_enough = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    in_reach = F.least(nx - px, ny - py) >= shared
    spare = (nx - px) + (ny - py) - 2 * shared
    alike = _apart(F.col("x.near"), F.col("y.near")) + _apart(F.col("x.far"), F.col("y.far")) <= spare
    return long_enough & in_reach & alike


def star_pairs(table: DataFrame, percent: int, turn: int) -> DataFrame:
    """``(a, b)``: every set of a block with one of them, another one for each ``turn``."""
    row = F.struct(F.xxhash64("doc", F.lit(turn)).alias("by"), "doc", "n", "pos", "near", "far")
    leaders = table.groupBy("token").agg(F.min(row).alias("y"))
    met = skew.spread(table, leaders, ["token"], ["doc"]).alias("x")
    return (
        met.filter((F.col("x.doc") != F.col("y.doc")) & may_link(percent))
        .select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
        .distinct()
    )


def block_pairs(table: DataFrame, percent: int, roots: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: pairs of sets that share a prefix n-gram and pass the filters, once each.

    With ``roots`` (node, root), pairs of one component are left out.
    """
    if roots is None:
        rows, apart = table, F.lit(True)
    else:
        placed = skew.attach(table, roots.withColumnRenamed("node", "doc"), ["doc"], how="left")
        placed = placed.withColumn("root", F.coalesce("root", "doc"))
        mixed = (
            placed.groupBy("token")
            .agg(F.min("root").alias("low"), F.max("root").alias("high"))
            .filter("low <> high")
            .select("token")
        )
        rows = scratch.store(skew.fetch(placed, mixed, ["token"]), "mixed")
        apart = F.col("x.root") != F.col("y.root")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.doc") < F.col("y.doc")) & apart
    return (
        rows.alias("x")
        .join(rows.alias("y"), met & may_link(percent))
        .select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
        .distinct()
    )


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(doc, grams)`` of the sets ``wanted(doc)``, from one row each; other rows are not hashed."""
    schema = pa.schema([("doc", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def work(batches: Iterator[list]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            fresh = _fresh(batch, seen)
            if fresh:
                yield _batch(([r[1] for r in fresh], [r[2].view(np.int64) for r in fresh]), schema)

    marks = rows.join(wanted, "doc", "left_semi").groupBy("doc").agg(F.min("mark").alias("mark")).select("mark")
    found = skew.fetch(_marked(docs), marks, ["mark"])
    return scratch.store(_hashed(found, size, work, "doc long, grams array<long>"), "sets")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose sets are similar enough, with ``shared`` n-grams.

    A set that very many others are compared with is copied for them.
    """
    pairs = scratch.store(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("doc")).unionAll(pairs.select("b")).distinct()
    sets = _sets(docs, rows, wanted, size)
    held = skew.spread(pairs, sets.select(F.col("doc").alias("a"), F.col("grams").alias("x")), ["a"], ["b"])
    hot = skew.hot_keys(pairs, ["b"])
    both = skew.spread(held, sets.select(F.col("doc").alias("b"), F.col("grams").alias("y")), ["b"], ["a"], hot)
    shared = F.size(F.array_intersect("x", "y"))
    enough = shared >= least_shared(percent, (F.size("x") + F.size("y")).cast("long"))
    # Rows that agree in id and text come twice where they are in two tasks.
    found = both.select("a", "b", shared.alias("shared"), enough.alias("enough")).filter("enough").drop("enough")
    return found.distinct()


def _prepared(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    rows, sketch = members(docs, size)
    places = docs.sparkSession.sparkContext.broadcast(ranks(sketch))
    return rows, blocks(docs, places, size, percent)


def links(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Membership ``(doc_id, doc, n)`` of every row and all links ``(a, b, shared)`` of sets.

    ``doc`` is the id of a row's set of n-grams, null for an empty one; equal sets are one.
    Every pair of different sets that are similar enough is listed once.
    """
    rows, table = _prepared(docs, shingle_words, percent)
    found = verified(block_pairs(table, percent), docs, rows, shingle_words, percent)
    return rows.select("doc_id", "doc", "n"), found


def connected(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links. Blocks are first
    compared with one of their sets, then all pairs that are not yet connected are: no link
    between components is missed, and a large group of near copies is not compared with itself.

    A null text counts as empty: size 0, linked with nothing. Repeated rows are repeated and
    linked; a null doc_id is kept and the component only where no row of it has an id.
    Other columns are not read; no rows give no rows.
    """
    rows, table = _prepared(docs, shingle_words, percent)
    stars = reduce(DataFrame.unionAll, [star_pairs(table, percent, turn) for turn in range(STAR_ROUNDS)]).distinct()
    known = scratch.store(verified(stars, docs, rows, shingle_words, percent).select("a", "b"), "links")
    rest = block_pairs(table, percent, components.connected(known))
    rest = scratch.store(verified(rest, docs, rows, shingle_words, percent).select("a", "b"), "links")
    roots = components.connected(known.unionAll(rest))
    # Sets in several rows, and linked ones; of all others the row's own id is the component.
    classes = rows.filter("doc is not null").groupBy("doc").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    every = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    placed = classes.join(every.withColumnRenamed("node", "doc"), "doc", "left").filter(
        "copies > 1 or root is not null"
    )
    placed = scratch.store(placed.withColumn("root", F.coalesce("root", "doc")), "classes")
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root").select("doc", "component_id")
    return skew.attach(rows, named, ["doc"], ["doc_id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
