"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank and cut into blocks. The bits that
all of a block share are its node in the upper index: a fingerprint is sent only
to blocks where it differs from those bits in at most ``max_bits`` places. Inside
a block the same factoring goes on, level by level, and a search drops a whole
group of fingerprints once its accumulated differences pass the limit.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave import scratch
from evalweave.llm import bits, components
from evalweave.operators import skew

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# A block's size to aim at. The upper index has MAX_BLOCKS nodes at most, 24 bytes
# each, which bounds what every task is sent; beyond that, blocks grow.
BLOCK_ROWS = 16_384
MAX_BLOCKS = 4096
# Fingerprints searched at a time, which bounds a task's frontier.
SEARCHED = 2048
# Rows whose shingles are held at a time.
HASHED_ROWS = 256
_FAN = 4
_LEAF = 16


def shingle_hashes(text: bytes, shingle_words: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII spaces only
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    if n <= shingle_words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle_words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle_words - 1 :].tolist())]


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, mark, fp)`` per row of ``docs``: ``fp`` a signed 64-bit SimHash of the whole text,
    ``mark`` a hash of id and text, by which a row is told from others of its id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, HASHED_ROWS) for b in batches for at in range(0, b.num_rows, HASHED_ROWS)):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            runs = [shingle_hashes(t or b"", shingle_words) for t in texts]
            sizes = np.fromiter(map(len, runs), np.int64, len(runs))
            flat = np.empty(int(sizes.sum()), dtype=np.uint64)
            at = 0
            for run in runs:
                flat[at : at + len(run)] = run
                at += len(run)
            fps = bits.as_signed(bits.majorities(flat, sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "mark", "fp"])

    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    return docs.select(doc_id, _mark().alias("mark"), text).mapInArrow(work, "doc_id long, mark long, fp long")


def _mark() -> Column:
    return F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def gray_rank(fp: Column) -> Column:
    """The place of ``fp`` in Gray order, as a long that sorts like the unsigned rank."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Nodes over a Gray-ordered list: each has the bits its children share."""

    def __init__(self, shared: np.ndarray, pattern: np.ndarray):
        """Leaves: ``pattern`` on the bits of ``shared``; whole values share all bits."""
        self.levels = [(shared, pattern)]
        fan = _LEAF
        while len(self.levels[-1][0]) > 1:
            mask, value = self.levels[-1]
            cuts = np.arange(0, len(mask), fan)
            every = np.bitwise_and.reduceat(mask, cuts)
            ones = np.bitwise_and.reduceat(value | ~mask, cuts)
            some = np.bitwise_or.reduceat(value & mask, cuts)
            both = every & ~(ones ^ some)
            self.levels.append((both, ones & both))
            fan = _FAN

    def search(self, wanted: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``wanted``, leaf) with at most ``most`` differing shared bits."""
        mask, value = self.levels[-1]
        who = np.repeat(np.arange(len(wanted)), len(mask))
        node = np.tile(np.arange(len(mask)), len(wanted))
        apart = np.bitwise_count((wanted[who] ^ value[node]) & mask[node]).astype(np.int16)
        for level in range(len(self.levels) - 1, 0, -1):
            near = apart <= most
            who, node, apart = who[near], node[near], apart[near]
            above = self.levels[level][0][node]
            mask, value = self.levels[level - 1]
            fan = _LEAF if level == 1 else _FAN
            child = (node[:, None] * fan + np.arange(fan)).reshape(-1)
            real = child < len(mask)
            child = child[real]
            who, above, apart = (np.repeat(x, fan)[real] for x in (who, above, apart))
            fresh = mask[child] & ~above  # what the parent has not counted yet
            apart = apart + np.bitwise_count((wanted[who] ^ value[child]) & fresh)
            node = child
        near = apart <= most
        return who[near], node[near]


def _ranks(fps: np.ndarray) -> np.ndarray:
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a[i] and b[i]; roots are the smallest members."""
    while True:
        a, b = parent[a], parent[b]
        open_ = a != b
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent[:] = above


def forest(members: np.ndarray, visitors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``most`` bits in one block.

    Visitors are compared with members, not with each other. Of each connected
    set only the links to its root come back, never all its pairs.
    """
    everyone = np.concatenate([members[np.argsort(_ranks(members))], visitors])
    members = everyone[: len(members)]
    index = GrayIndex(np.full(len(members), ~np.uint64(0)), members)
    parent = np.arange(len(everyone))
    for start in range(0, len(everyone), SEARCHED):
        who, leaf = index.search(everyone[start : start + SEARCHED], most)
        _join(parent, who + start, leaf)
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return everyone[moved], everyone[parent[moved]]


def _routed(blocks: DataFrame, nodes: list, most: int) -> DataFrame:
    """``(block, member, fps)``: fingerprints for their block and for later ones they may match.

    ``fps`` packs all that a batch has for a block, eight bytes each.
    """
    numbers = np.array([n["block"] for n in nodes], dtype=np.int64)
    ones = bits.as_unsigned(np.array([n["ones"] for n in nodes], dtype=np.int64))
    some = bits.as_unsigned(np.array([n["some"] for n in nodes], dtype=np.int64))
    shared = ~(ones ^ some)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = GrayIndex(shared, ones & shared)
        for batch in batches:
            fps = bits.as_unsigned(batch["fp"].to_numpy())
            own = batch["block"].to_numpy()
            sent = []
            for start in range(0, len(fps), SEARCHED):
                who, leaf = upper.search(fps[start : start + SEARCHED], most)
                who, to = who + start, numbers[leaf]
                ahead = to >= own[who]
                sent.append((who[ahead], to[ahead]))
            if not sent:
                continue
            who, to = (np.concatenate(x) for x in zip(*sent))
            member = to == own[who]
            order = np.lexsort((member, to))
            who, to, member = who[order], to[order], member[order]
            cuts = np.flatnonzero(np.diff(to * 2 + member, prepend=-1))
            packed = [part.tobytes() for part in np.split(fps[who].astype("<u8"), cuts[1:])]
            yield pd.DataFrame({"block": to[cuts].astype(np.int32), "member": member[cuts], "fps": packed})

    return blocks.mapInPandas(work, "block int, member boolean, fps binary")


def links(fps: DataFrame, rows: int, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``(a, b)`` connecting the distinct fingerprints ``fps(fp)`` within ``max_bits``."""
    count = max(1, min(MAX_BLOCKS, -(-rows // block_rows)))
    sorted_fps = fps.select("fp").repartitionByRange(count, gray_rank(F.col("fp")))
    blocks = scratch.store(sorted_fps.select(F.spark_partition_id().alias("block"), "fp"), "gray")
    nodes = (
        blocks.groupBy("block")
        .agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some"))
        .orderBy("block")
        .collect()  # MAX_BLOCKS rows at most
    )
    if not nodes:
        return blocks.select(F.col("fp").alias("a"), F.col("fp").alias("b"))

    def block_links(group: pd.DataFrame) -> pd.DataFrame:
        def unpacked(rows: pd.Series) -> np.ndarray:
            return np.frombuffer(b"".join(rows), dtype="<u8").astype(np.uint64)

        member = group["member"].to_numpy()
        a, b = forest(unpacked(group["fps"][member]), unpacked(group["fps"][~member]), max_bits)
        return pd.DataFrame({"a": bits.as_signed(a), "b": bits.as_signed(b)})

    return _routed(blocks, nodes, max_bits).groupBy("block").applyInPandas(block_links, "a long, b long")


def _components(known: DataFrame, max_bits: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of ``known(doc_id, fp)``: the fingerprints ``(fp, first, rows)`` with their smallest id, and the
    links ``(fp, root)`` of those that others are near."""
    classes = scratch.write(
        known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "classes"
    )
    roots = scratch.store(
        components.connected(links(classes.df, classes.rows, max_bits, block_rows)), "roots"
    )
    everyone = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    return classes.df, everyone.withColumnRenamed("node", "fp")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    Fingerprints link at ``max_bits`` or fewer differing bits; ``component_id`` is
    the smallest doc_id reachable. A null text counts as empty (fingerprint zero,
    linked like any other). Repeated rows are repeated in the result. A null
    doc_id is kept and never the smallest; it is the component only if no member
    has an id. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    known = scratch.store(fingerprints(docs, shingle_words), "fingerprints")
    classes, everyone = _components(known, max_bits, block_rows)
    # Fingerprints of several rows, and linked ones; any other row is its own component.
    shared = classes.join(everyone, "fp", "left").filter("rows > 1 or root is not null")
    shared = scratch.store(shared.withColumn("root", F.coalesce("root", "fp")), "shared")
    smallest = shared.groupBy("root").agg(F.min("first").alias("component_id"))
    named = shared.join(smallest, "root").select("fp", "component_id")
    return skew.attach(known, named, ["fp"], ["doc_id"], "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def deduplicate(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, then hash of its text.

    Rows are told apart by id and text, so a different text under a repeated id is judged by
    itself; of rows that agree in both, one stays. Rows without an id take part and come last.
    """
    known = scratch.store(fingerprints(docs, shingle_words), "fingerprints")
    _, everyone = _components(known, max_bits, BLOCK_ROWS)
    root = F.coalesce("root", "fp").alias("root")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    kept = (
        skew.attach(known, everyone, ["fp"], ["mark"], "left")
        .groupBy(root)
        .agg(F.min(place).alias("place"))
        .select("place.mark")
    )
    twice = known.groupBy("mark").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("mark")
    kept, twice = scratch.write(kept, "kept"), scratch.write(twice, "twice")
    names = [f"`{name}`" for name in docs.columns]
    marked = docs.select(F.struct(*names).alias("row"), _mark().alias("mark"))
    found = skew.attach(marked, kept, ["mark"], how="left_semi")
    # Only rows that are repeated word for word are brought together.
    repeated = skew.attach(found, twice, ["mark"], how="left_semi").dropDuplicates(["mark"])
    return skew.attach(found, twice, ["mark"], how="left_anti").unionAll(repeated).select("row.*")
