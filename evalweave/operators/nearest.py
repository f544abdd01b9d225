"""Contexts by cosine: exact, by blocks of vectors, or over inverted lists.

Vectors are compared in Arrow batches, one matrix product for all vectors of a block
and all targets that look into it. An index deals the vectors to lists around
centroids. A search looks into the lists nearest to each target and then, to be exact,
into every other list that the angles do not rule out.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave import scratch
from evalweave.operators import skew

TARGET = ("grp", "target_id", "target_pos")
# Vectors in a block that one task multiplies at once.
BLOCK_ROWS = 8192
# Centroids are fitted on so many vectors at most, those of the smallest hashes.
SAMPLE_ROWS = 20_000
ROUNDS = 10
# The list of vectors without a direction: null, of length 0 or of another length.
NO_LIST = -1
# Slack for sums of products in another order.
_SLACK = 1e-9


@dataclass(frozen=True)
class Lists:
    """Centroids of the inverted lists, one row each, and how many to look into first."""

    centroids: np.ndarray
    probes: int


def _matrix(column, size: int) -> np.ndarray:
    """Unit vectors of a list column, zeros where there is none of ``size`` numbers."""
    out = np.zeros((len(column), size))
    if not len(column) or not size:
        return out
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array([len(x.values) if x.is_valid else -1 for x in column])
    usable = lengths == size
    if usable.any():
        kept = column.filter(pa.array(usable))
        out[usable] = kept.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    out[~np.isfinite(out).all(axis=1)] = 0
    lengths = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 0)


def fit(vectors: DataFrame, lists: int, probes: int, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> Lists:
    """Centroids by spherical k-means on a sample of at most ``sample_rows`` vectors.

    The sample is the vectors with the smallest seeded hashes of their id; every vector is indexed.
    """
    order = F.xxhash64("id", F.lit(seed))
    rows = vectors.filter(F.col("embedding").isNotNull()).orderBy(order, "id").limit(sample_rows).select("embedding")
    found = rows.toArrow().column(0).combine_chunks()
    sizes = np.array([len(x.values) for x in found], dtype=int)
    sample = _matrix(found, int(np.bincount(sizes).argmax()) if len(sizes) else 0)
    sample = sample[(sample != 0).any(axis=1)]
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:lists]]
    for _ in range(ROUNDS):
        nearest = (sample @ centroids.T).argmax(axis=1) if len(centroids) else np.zeros(0, int)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(lengths > 0, sums / np.maximum(lengths, 1e-300), centroids)
    return Lists(centroids, probes)


def _angles(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centroids.T, -1.0, 1.0))


def _placed(rows: DataFrame, index: Lists) -> DataFrame:
    """``rows(grp, id, embedding)`` with their ``list`` and the ``angle`` to its centroid."""
    centroids = index.centroids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("embedding"), centroids.shape[1])
            lists = np.full(len(vectors), NO_LIST, dtype=np.int32)
            angles = np.zeros(len(vectors))
            some = (vectors != 0).any(axis=1)
            if some.any() and len(centroids):
                apart = _angles(vectors[some], centroids)
                lists[some] = apart.argmin(axis=1)
                angles[some] = apart.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists), pa.array(angles)], [*batch.schema.names, "list", "angle"]
            )

    schema = T.StructType([*rows.schema, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return rows.mapInArrow(work, schema)


def _aims(targets: DataFrame, index: Lists) -> DataFrame:
    """``targets`` with the angle to every centroid, one row per list."""
    centroids = index.centroids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("target_vector"), centroids.shape[1])
            angles = list(_angles(vectors, centroids)) if len(centroids) else [[] for _ in vectors]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(angles, pa.list_(pa.float64()))], [*batch.schema.names, "angles"]
            )

    schema = T.StructType([*targets.schema, T.StructField("angles", T.ArrayType(T.DoubleType()))])
    found = targets.mapInArrow(work, schema)
    # A vector without direction is as near to one target as to another.
    aims = found.select(*targets.columns, F.posexplode("angles").alias("list", "target_angle"))
    return aims.unionAll(targets.withColumns({"list": F.lit(NO_LIST), "target_angle": F.lit(0.0)}))


def _best(
    ids: np.ndarray, vectors: np.ndarray, target_ids: list, targets: np.ndarray, n: int, digits: int
) -> Iterator[tuple[int, list, list]]:
    """Per target its place, and the ids and cosines of the ``n`` nearest other ids of a block.

    An id in several rows counts with the nearest. No direction, no cosine: null, after all others.
    """
    cosines = vectors @ targets.T
    cosines[~(vectors != 0).any(axis=1)] = -np.inf
    cosines[:, ~(targets != 0).any(axis=1)] = -np.inf
    names, place = np.unique(ids, return_inverse=True)
    order = np.argsort(place, kind="stable")
    cosines = np.maximum.reduceat(cosines[order], np.flatnonzero(np.diff(place[order], prepend=-1)))
    for j, target_id in enumerate(target_ids):
        column = np.round(cosines[:, j], digits)
        column[names == target_id] = np.nan
        if len(column) > n:
            # Enough for n, the target itself and all ties of the last.
            least = -np.partition(-np.where(np.isnan(column), -np.inf, column), n - 1)[n - 1]
            kept = np.flatnonzero(column >= least)
        else:
            kept = np.flatnonzero(~np.isnan(column))
        kept = kept[np.argsort(-column[kept], kind="stable")][:n]  # names are sorted: ties by id
        found = cosines[kept, j]
        yield j, names[kept].tolist(), [float(c) if np.isfinite(c) else None for c in found]


def _scored_in(left: pa.Table, right: pa.Table, n: int, digits: int, kinds: Sequence[pa.DataType]) -> pa.Table:
    """The nearest of the vectors ``left`` for each target of ``right``, as a table."""
    out = [[], [], [], [], []]
    lengths = [len(x.values) if x.is_valid else 0 for x in right.column("target_vector")]
    for size in sorted(set(lengths)) if left.num_rows else ():
        wanted = right.filter(pa.array([x == size for x in lengths]))
        ids = left.column("id").to_numpy()
        targets = _matrix(wanted.column("target_vector"), size)
        rows = wanted.select(TARGET).to_pylist()
        found = _best(ids, _matrix(left.column("embedding"), size), [r["target_id"] for r in rows], targets, n, digits)
        for j, names, cosines in found:
            columns = (*([rows[j][c]] * len(names) for c in TARGET), names, cosines)
            for held, values in zip(out, columns):
                held += values
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [*TARGET, "context_id", "cosine"])


def _schema(targets: DataFrame, rows: DataFrame) -> T.StructType:
    kinds = [targets.schema[c].dataType for c in TARGET] + [rows.schema["id"].dataType, T.DoubleType()]
    return T.StructType([T.StructField(n, k) for n, k in zip([*TARGET, "context_id", "cosine"], kinds)])


def _blocks(rows: DataFrame, targets: DataFrame, key: Sequence[str], n: int, digits: int) -> DataFrame:
    """The nearest of ``rows`` for each of ``targets`` in every block of an equal ``key``.

    Rows of a key are dealt by id to blocks of about ``BLOCK_ROWS``, and each block gets the key's
    targets: neither a large group nor a large list is ever in one task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    asked = targets.select(*key).distinct()
    wanted = skew.attach(rows, asked, key, ["id"], "left_semi")
    counts = wanted.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = scratch.write(counts, "blocks")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = skew.attach(wanted, sizes, key, ["id"]).withColumn("block", block)
    copied = skew.attach(targets, sizes, key, ["target_id"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    schema = _schema(targets, rows)
    kinds = [to_arrow_type(f.dataType) for f in schema]
    named = [F.col(k).alias(f"_{k}") for k in key]
    left = dealt.select(*named, F.col("block").alias("_block"), "id", "embedding")
    right = copied.select(*[F.col(k).alias(f"_at_{k}") for k in key], F.col("block").alias("_at"), *TARGET, "target_vector")

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        return _scored_in(a, b, n, digits, kinds)

    groups = left.groupBy(*[f"_{k}" for k in key], "_block")
    return groups.cogroup(right.groupBy(*[f"_at_{k}" for k in key], "_at")).applyInArrow(work, schema)


def _where_they_are(rows: DataFrame, targets: scratch.Written, n: int, digits: int) -> DataFrame:
    """The nearest of every Arrow batch of ``rows``: few targets go to the vectors."""
    from pyspark.sql.pandas.types import to_arrow_type

    held = rows.sparkSession.sparkContext.broadcast(targets.df.select(*TARGET, "target_vector").toArrow())
    schema = _schema(targets.df, rows)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for i, grp in enumerate(held.value.column("grp").to_pylist()):
            known.setdefault(grp, []).append(i)
        for batch in batches:
            members = {}
            for i, grp in enumerate(batch.column("grp").to_pylist()):
                members.setdefault(grp, []).append(i)
            table = pa.Table.from_batches([batch])
            for grp in members.keys() & known.keys():
                found = _scored_in(table.take(members[grp]), held.value.take(known[grp]), n, digits, kinds)
                yield from found.to_batches()

    return rows.select("grp", "id", "embedding").mapInArrow(work, schema)


def _ranked(found: DataFrame, n: int, digits: int) -> DataFrame:
    """The nearest of what the blocks found, an id once, numbered from 0."""
    once = found.groupBy(*TARGET, "context_id").agg(F.round(F.max("cosine"), digits).alias("cosine"))
    order = [F.col("cosine").desc_nulls_last(), F.col("context_id")]
    ranked = skew.top_n(once, TARGET[:2], order, n, "context_pos")
    return ranked.select(*TARGET, "context_id", "cosine", "context_pos")


def _with_vectors(rows: DataFrame, targets: DataFrame) -> scratch.Written:
    """Targets with their vector; one listed with several has that of the smallest hash."""
    chosen = rows.select("grp", F.col("id").alias("target_id"), F.col("embedding").alias("target_vector"))
    found = skew.attach(chosen, targets.select(*TARGET), TARGET[:2])
    first = Window.partitionBy(*TARGET[:2]).orderBy(F.xxhash64("target_vector"))
    once = found.withColumn("place", F.row_number().over(first)).filter("place = 1")
    return scratch.write(once.select(*TARGET, "target_vector"), "target-vectors")


def nearest_contexts(
    vectors: DataFrame, targets: DataFrame, group_col: str, n_contexts: int, digits: int = 6
) -> DataFrame:
    """The ``n_contexts`` other ids of its group closest to each target by cosine.

    ``vectors`` has ``id``, ``embedding`` and the group column. Cosines are compared at ``digits``
    decimals, ties by id. A vector that is null, of length 0 or of another length than the target's has
    a null cosine and comes last. An id with several vectors counts with the nearest.

    Up to ``skew.BROADCAST_BYTES`` of targets, these are sent to the vectors, which stay where they
    are; more targets meet the vectors of their group in blocks.
    """
    rows = vectors.filter(F.col("id").isNotNull() & F.col(group_col).isNotNull()).select(
        F.col(group_col).alias("grp"), "id", "embedding"
    )
    wanted = _with_vectors(rows, targets)
    if wanted.bytes <= skew.BROADCAST_BYTES:
        found = _where_they_are(rows, wanted, n_contexts, digits)
    else:
        found = _blocks(rows, wanted.df, ["grp"], n_contexts, digits)
    return _ranked(found, n_contexts, digits)


def indexed_contexts(
    vectors: DataFrame,
    targets: DataFrame,
    group_col: str,
    n_contexts: int,
    index: Lists,
    digits: int = 6,
    exact: bool = True,
) -> DataFrame:
    """``nearest_contexts`` over the inverted lists of ``index``.

    Each target looks into the ``index.probes`` lists of its group with the nearest centroids. If
    ``exact``, it then looks into every other list whose vectors could still be near enough: a vector
    at most r away from its centroid is at least (angle to the centroid) - r away from the target.
    Otherwise some of the nearest may be missed. Vectors without a direction are a list of their own, which
    every target looks into.
    """
    rows = vectors.filter(F.col("id").isNotNull() & F.col(group_col).isNotNull()).select(
        F.col(group_col).alias("grp"), "id", "embedding"
    )
    placed = scratch.store(_placed(rows, index), "placed")
    sizes = placed.groupBy("grp", "list").agg(F.max("angle").alias("reach"))
    wanted = _with_vectors(rows, targets).df
    aims = skew.attach(_aims(wanted, index), sizes, ["grp", "list"], ["target_id"])
    near = Window.partitionBy(*TARGET).orderBy("target_angle", "list")
    ranked = scratch.store(aims.withColumn("place", F.row_number().over(near)), "aims")
    first = (F.col("place") <= index.probes) | (F.col("list") == NO_LIST)
    key = ["grp", "list"]
    found = scratch.store(_blocks(placed, ranked.filter(first), key, n_contexts, digits), "found")
    if exact:
        known = _ranked(found, n_contexts, digits).filter(F.col("context_pos") == n_contexts - 1)
        last = known.select(*TARGET, F.col("cosine").alias("last"))
        left = ranked.filter(~first).join(last, list(TARGET), "left")
        most = F.cos(F.greatest(F.col("target_angle") - F.col("reach"), F.lit(0.0))) + 10.0**-digits + _SLACK
        open_ = left.filter(F.col("last").isNull() | (most >= F.col("last"))).drop("last")
        found = found.unionByName(_blocks(placed, open_, key, n_contexts, digits))
    return _ranked(found, n_contexts, digits)
