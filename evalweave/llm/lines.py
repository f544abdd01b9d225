"""Fuzzy line deduplication.

Lines are normalised and hashed; equal ones are one class. The SimHash of a class is made
of blocks: the line is cut into segments at words that its own content chooses, and each
segment gives one block, so a change spoils only the blocks around it. Lines meet on
pigeonhole keys, a choice of blocks that agree. Pairs are verified by edit similarity,
and of each connected group one occurrence stays, the first by document and line.

The lines of a key are compared with their texts where the key is read: a pair only under the
first key that it shares, and only while the key's lines before it have not connected it, so a group of
near lines is not spelled out in pairs. Keys of very many lines are first compared with one line, then
with another one of a group that it is not in yet; what this leaves in different groups is compared in
tiles, dealt to many tasks. So no link that matters is lost.
"""

import itertools
import re
from collections.abc import Iterator
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave import scratch
from evalweave.llm import bits, components, edit
from evalweave.operators import skew

# Segments of a line, and how many of their blocks a key is made of.
SEGMENTS = 6
AGREEING = 2
SIMILAR_PERCENT = 80
# Lines of fewer words are cut between letters.
WORDS = 5
# Letters of lines hashed at a time.
HASHED_LETTERS = 250_000
# Lines of a key that are compared together; keys of more are dealt in tiles of so many.
TILE = 128
# Keys of more lines are first compared with one line of a group, so many times.
HOT = 2048
STAR_ROUNDS = 3
# Rows of keys that are read together, and bytes.
TOGETHER = 40_000
TOGETHER_BYTES = 1 << 23
# Pairs looked at together, those that wait for their edit distances, and bits of a key that tell its choice of blocks.
PAIRS = 1 << 19
OPEN = 1 << 14
CHOICE_BITS = 8
# Classes that letters are counted in.
LANES = 16
_BETWEEN = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d+")
# What no line of these alone is counted for.
_BLANKS = " \t\n\x0b\f\r"
# Hashes of words and lines are sums of their letters' numbers, each times a power by its place.
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


def normalise(line: str) -> str:
    """Lower-case words with single spaces; numbers become 0. A line without a letter
    or digit stays as it is but for the spaces around it."""
    line = line.lower()
    return _DIGITS.sub("0", _BETWEEN.sub(" ", line).strip()) or line.strip()


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@cache
def _kinds() -> np.ndarray:
    """Of every letter: 2 a digit, 1 another part of a word, 0 none."""
    letters = map(chr, range(0x110000))
    return np.fromiter((c.isalnum() + c.isdecimal() for c in letters), np.uint8, 0x110000)


@cache
def _numbers() -> np.ndarray:
    return _mixed(np.arange(1, 0x110001, dtype=np.uint64))


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    powers = np.full(size, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


class Lines:
    """Normalised lines, all letters of which are in one array."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Lines come in the order of their letters."""
        self.letters, self.starts, self.sizes = letters, starts, sizes
        self.numbers = _numbers()[letters]
        size = 1 << max(16, len(letters).bit_length())
        sums = np.cumsum(self.numbers * _powers(_BASE, size)[: len(letters)])
        self._sums = np.concatenate((np.zeros(1, np.uint64), sums))
        self._back = _powers(pow(_BASE, -1, 1 << 64), size)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the letters from each start to its end, wherever they stand."""
        return _mixed((self._sums[ends] - self._sums[starts]) * self._back[starts] + (ends - starts).astype(np.uint64))

    def lines(self) -> np.ndarray:
        return self.hashes(self.starts, self.starts + self.sizes)

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words of all lines, or of the letters of those with few; units per line;
        and hashes that choose the cuts, of a letter with the next."""
        space = self.letters == 32
        first = np.zeros(len(space) + 1, dtype=bool)
        first[self.starts[self.sizes > 0]] = first[-1] = True
        opens = ~space & (first[:-1] | np.roll(space, 1))
        closes = ~space & (first[1:] | np.roll(space, -1))
        begins, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        n_words = np.diff(np.searchsorted(begins, np.append(self.starts, len(space))))
        by_word = n_words >= WORDS
        words = self.hashes(begins, ends)
        if by_word.all():
            return words, n_words, _mixed(words)
        counts = np.where(by_word, n_words, self.sizes)
        is_word = np.repeat(by_word, counts)
        units = np.empty(int(counts.sum()), dtype=np.uint64)
        units[is_word] = words[np.repeat(by_word, n_words)]
        units[~is_word] = self.numbers[np.repeat(~by_word, self.sizes)]
        following = np.append(units[1:], np.uint64(0))
        following[np.cumsum(counts)[counts > 0] - 1] = 0
        choosing = units.copy()
        choosing[~is_word] += following[~is_word] * np.uint64(3)
        return units, counts, _mixed(choosing)

    def blocks(self, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """The SimHash of each segment in 32 bits, one row a line, and whether the segment is empty."""
        units, counts, choosing = self.units()
        sizes = np.diff(_cuts(counts, choosing, segments), axis=1)
        found = bits.low_majorities(units, sizes.reshape(-1))
        return found.view(np.int32).reshape(sizes.shape), sizes == 0

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        """How often letters of each of sixteen classes occur, modulo 256, in two longs."""
        lane = (self.numbers >> np.uint64(60)).astype(np.int64)
        line = np.repeat(np.arange(len(self.starts)), self.sizes)
        counts = np.bincount(line * LANES + lane, minlength=LANES * len(self.starts))
        both = counts.astype(np.uint8).reshape(-1, LANES).view("<i8")
        return both[:, 0], both[:, 1]


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def of_normal(lines: list[str]) -> Lines:
    """Lines that are in normal form already."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return Lines(_letters("".join(lines)), np.cumsum(sizes) - sizes, sizes)


def normalised(text: str) -> tuple[np.ndarray, Lines]:
    """``normalise`` of every line of ``text`` with a visible character, all at once, and their places.

    The places are not in order.
    """
    # Line by line, as texts of plain letters are made small much faster.
    text = "\n".join([line.lower() for line in text.split("\n")])
    letters = _letters(text)
    breaks = np.flatnonzero(letters == 10)
    starts, ends = np.append(0, breaks + 1), np.append(breaks, len(letters))
    kind = _kinds()[letters]
    before = np.append(np.uint8(0), kind[:-1])
    kept = (kind == 1) | (kind == 2) & (before != 2)
    begins = np.flatnonzero((kind != 0) & (before == 0))
    first = np.searchsorted(begins, starts)
    worded = np.append(first[1:], len(begins)) > first
    # One space before a word, unless it is the first of its line.
    later = np.ones(len(begins), dtype=bool)
    later[first[worded]] = False
    kept[begins[later] - 1] = True
    out, kinds = letters[kept], kind[kept]
    out[kinds == 2], out[kinds == 0] = 48, 32
    sizes = np.add.reduceat(kept, starts[worded], dtype=np.int64) if len(begins) else np.zeros(0, dtype=np.int64)
    # Lines without a word stay as they are but for the spaces around them.
    plain = np.flatnonzero(~worded & (ends > starts))
    bare = [(i, text[a:b].strip()) for i, a, b in zip(plain.tolist(), starts[plain].tolist(), ends[plain].tolist())]
    bare = [(i, line) for i, line in bare if line]
    more = np.array([len(line) for _, line in bare], dtype=np.int64)
    numbers = np.concatenate((np.flatnonzero(worded), np.array([i for i, _ in bare], dtype=np.int64)))
    all_letters = np.concatenate((out, _letters("".join(line for _, line in bare))))
    all_sizes = np.concatenate((sizes, more))
    return numbers, Lines(all_letters, np.cumsum(all_sizes) - all_sizes, all_sizes)


def _cuts(counts: np.ndarray, choosing: np.ndarray, segments: int) -> np.ndarray:
    """Where each line is cut, a row of ``segments + 1`` places: around every place that would make
    equal parts, before the unit with the smallest hash."""
    n = counts[:, None]
    at = np.arange(1, segments) * n / segments
    reach = n / (2 * segments)
    begin = np.maximum(0, np.ceil(at - reach)).astype(np.int64)
    end = np.minimum(n, np.floor(at + reach).astype(np.int64) + 1)
    first = (np.cumsum(counts) - counts)[:, None]
    place = np.arange(len(choosing)) - np.repeat(first[:, 0], counts)
    ranked = np.append((choosing & ~_LOW) | place.astype(np.uint64), np.uint64(0))
    windows = np.stack([first + begin, first + end], axis=2).reshape(-1)
    least = np.minimum.reduceat(ranked, windows)[::2].reshape(begin.shape) if len(windows) else begin
    chosen = np.where(begin < end, (least.astype(np.uint64) & _LOW).astype(np.int64), np.rint(at).astype(np.int64))
    rows = np.concatenate([np.zeros_like(n), np.minimum(chosen, n), n], axis=1)
    return np.maximum.accumulate(rows, axis=1)


def _parts(text: str) -> Iterator[str]:
    """``text`` cut at line ends into parts of about ``HASHED_LETTERS``."""
    begin = 0
    while len(text) - begin > HASHED_LETTERS:
        cut = text.find("\n", begin + HASHED_LETTERS)
        if cut < 0:
            break
        yield text[begin:cut]
        begin = cut + 1
    yield text[begin:]


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` as ``row``, with ``doc``, by which its lines are known: a hash of id and text.

    Rows that agree in both are one document, whose lines stay or go alike.
    """
    row = docs.select(F.struct("*").alias("row"))
    text, doc_id = F.col("row.text").cast("string"), F.col("row.doc_id").cast("long")
    return row.select("row", doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), doc_id, text).alias("doc"))


def _blocks(segments: int) -> list[str]:
    return [f"block{i}" for i in range(segments)]


def occurrences(docs: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """``(doc, doc_id, line_no, line, size, near, far, block0, ...)`` for each line with a visible character.

    ``line`` is a 64-bit hash of the normalised line, ``size`` its letters, ``near`` and ``far`` their
    counts by class; a block is null where its segment is empty.
    """
    names = ["doc", "doc_id", "line_no", "line", "size", "near", "far", *_blocks(segments)]

    def hashed(parts: list[tuple[int, int | None, int, str]]) -> pa.RecordBatch:
        """Lines of ``(doc, doc_id, first line's number, text)``."""
        lines_in = [part[3].count("\n") + 1 for part in parts]
        numbers, lines = normalised("\n".join(part[3] for part in parts))
        ends = np.cumsum(lines_in)
        part = np.searchsorted(ends, numbers, "right")
        first = np.array([p[2] for p in parts]) - (ends - lines_in)
        values, empty = lines.blocks(segments)
        columns = [
            pa.array(np.array([p[0] for p in parts])[part]),
            pa.array([p[1] for p in parts], pa.int64()).take(pa.array(part)),
            pa.array((numbers + first[part]).astype(np.int32)),
            pa.array(bits.as_signed(lines.lines())),
            pa.array(lines.sizes.astype(np.int32)),
            *map(pa.array, lines.lanes()),
            *[pa.array(np.ascontiguousarray(values[:, i]), mask=empty[:, i]) for i in range(segments)],
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                number = 0
                for part in _parts(text.as_py() or ""):
                    held.append((doc, doc_id, number, part))
                    number += part.count("\n") + 1
                    size += len(part) + 1
                    if size >= HASHED_LETTERS:
                        yield hashed(held)
                        held, size = [], 0
        if held:
            yield hashed(held)

    rows = _identified(docs).select("doc", "doc_id", "text")
    schema = "doc long, doc_id long, line_no int, line long, size int, near long, far long"
    return rows.mapInArrow(work, ", ".join([schema, *[f"{name} int" for name in _blocks(segments)]]))


def _keyed(classes: DataFrame, segments: int, agreeing: int) -> DataFrame:
    """``(key, no)`` of each class once per choice of ``agreeing`` blocks, none of them empty.

    The lowest bits of a key tell the choice.
    """
    keys = []
    for place, chosen in enumerate(itertools.combinations(_blocks(segments), agreeing)):
        full = reduce(Column.__and__, [F.col(name).isNotNull() for name in chosen])
        key = F.shiftleft(F.xxhash64(F.lit(place), *chosen), CHOICE_BITS).bitwiseOR(F.lit(place))
        keys.append(F.when(full, key))
    return classes.select("no", F.explode(F.array(*keys)).alias("key")).filter("key is not null").select("key", "no")


def _shared(rows: DataFrame) -> DataFrame:
    """``(key, no, slot)``: the ``rows(key, no)`` whose key another one has, numbered within the key.

    Sorted rows pass by in batches, so a key of very many classes is never held.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The row before, which goes out if the next one has its key.
        held, slot = np.zeros((2, 0), dtype=np.int64), 0
        for batch in batches:
            keys, nos = np.concatenate((held, np.stack([batch.column(i).to_numpy() for i in (0, 1)])), axis=1)
            if not len(keys):
                continue
            opens = np.append(True, keys[1:] != keys[:-1])
            begins = np.flatnonzero(opens)
            slots = np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys))))
            slots[: begins[1] if len(begins) > 1 else None] += slot
            wanted = ~opens | np.append(~opens[1:], False)
            if held.shape[1] and slot:  # went out with the batch before
                wanted[0] = False
            held, slot = np.stack((keys[-1:], nos[-1:])), int(slots[-1])
            columns = [keys[wanted], nos[wanted], slots[wanted]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "no", "slot"])

    rows = rows.select("key", "no").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(shared, "key long, no long, slot long")


def _met(classes: DataFrame, segments: int, agreeing: int) -> DataFrame:
    """``(key, no, slot)``: the rows of ``_keyed`` whose key another class has, numbered within the key.

    Only blocks that are another class's too can be in such a key, so these are found first: a class
    has more keys than blocks.
    """
    names = _blocks(segments)
    held = _keyed(classes, segments, 1)
    segment = F.expr(f"shiftleft(1, cast(key & {(1 << CHOICE_BITS) - 1} as int))")
    masks = _shared(held).groupBy("no").agg(F.bit_or(segment).alias("mask"))
    masks = scratch.write(masks.filter(F.bit_count("mask") >= agreeing), "shared")
    left = skew.attach(classes.select("no", *names), masks, ["no"])
    blocks = [F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(name)).alias(name) for i, name in enumerate(names)]
    return _shared(_keyed(left.select("no", *blocks), segments, agreeing))


def _apart(x: Column, y: Column) -> Column:
    """Sum over eight counters of how far apart they are, at the least."""
    total = F.lit(0)
    for lane in range(8):
        of_x, of_y = (F.shiftrightunsigned(c, 8 * lane).bitwiseAND(F.lit(255)) for c in (x, y))
        gap = F.abs(of_x - of_y)
        total = total + F.least(gap, 256 - gap)
    return total


def may_be_alike(percent: int) -> Column:
    """Whether the sizes and letters of ``x`` and ``y`` leave so many edits: one changes two counts."""
    longer = F.greatest("x.size", "y.size")
    budget = F.floor(longer * (100 - percent) / 100)
    letters = _apart(F.col("x.near"), F.col("y.near")) + _apart(F.col("x.far"), F.col("y.far"))
    return (longer - F.least("x.size", "y.size") <= budget) & (letters <= 2 * budget)


def _mixed_keys(met: DataFrame, roots: DataFrame) -> scratch.Written:
    """The rows of keys whose classes are still in different groups, with their ``root``."""
    placed = met.join(roots.withColumnRenamed("node", "no"), "no", "left")
    placed = placed.withColumn("root", F.coalesce("root", "no"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return scratch.write(skew.fetch(placed, mixed.filter("low <> high").select("key"), ["key"]), "mixed")


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of the classes of each mixed key with one of another group, another one each ``turn``."""
    row = F.struct(F.xxhash64("no", F.lit(turn)).alias("by"), "no", "root", "size", "near", "far")
    leaders = rows.groupBy("key").agg(F.min(row).alias("y"))
    met = skew.spread(rows, leaders, ["key"], ["no"]).alias("x")
    near = (F.col("x.root") != F.col("y.root")) & may_be_alike(percent)
    return _in_order(met.filter(near).select(F.col("x.no").alias("a"), F.col("y.no").alias("b")))


def _spelled(nos: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The ``classes`` of ``nos``, with the normalised ``text`` of their lines; texts are read for these only."""
    held = [name for name in classes.columns if name not in ("line", "n", "doc", "line_no")]
    place = ["doc", "line_no"]
    wanted = scratch.write(skew.attach(classes.drop("line", "n"), nos, ["no"]), "wanted")
    sizes = scratch.Written(wanted.df.select(*place), wanted.rows, 2 * scratch.FIXED_BYTES * wanted.rows)
    docs = _identified(docs).select("doc", "text")
    docs = skew.fetch(docs, wanted.df.select("doc").distinct(), ["doc"])
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    texts = skew.attach(skew.fetch(lines, sizes, place), wanted, place).select(*held, "text")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = pa.array([normalise(line) for line in batch.column(len(held)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], spelled], [*held, "text"])

    return texts.mapInArrow(spell, texts.schema).dropDuplicates(["no"])


class _Compared:
    """Rows of keys, each with its line's text, compared with the others of their key and cell."""

    def __init__(self, batch: pa.RecordBatch, segments: int):
        def column(name: str) -> np.ndarray:
            return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

        self.keys, self.cells, self.tiles = column("key"), column("cell"), column("tile")
        self.nos, self.roots, self.sizes = column("no"), column("root"), column("size").astype(np.int64)
        lanes = np.stack((column("near"), column("far")), axis=1)
        self.lanes = np.ascontiguousarray(lanes, dtype="<i8").view(np.uint8)
        filled = [batch.column(batch.schema.get_field_index(name)) for name in _blocks(segments)]
        self.blocks = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in filled], axis=1)
        self.full = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in filled], axis=1)
        self.texts = batch.column(batch.schema.get_field_index("text"))
        opens = np.append(True, (self.keys[1:] != self.keys[:-1]) | (self.cells[1:] != self.cells[:-1]))
        begins = np.flatnonzero(opens)
        self.last = int(begins[-1])
        ends = np.append(begins[1:], len(opens))
        self.ends = np.repeat(ends, ends - begins)

    def pairs(self, rows: int, segments: int, agreeing: int, percent: int) -> Iterator[tuple[int, int]]:
        """Pairs of the first ``rows`` that meet here first and whose sizes and letters allow that they are alike."""
        choices = np.array(list(itertools.combinations(range(segments), agreeing)))
        counts = self.ends[:rows] - np.arange(rows) - 1
        before = np.cumsum(counts) - counts
        begin = 0
        while begin < rows:
            end = max(begin + 1, int(np.searchsorted(before, before[begin] + PAIRS)))
            n = counts[begin:end]
            x = np.repeat(np.arange(begin, end), n)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            begin = end
            tiled = (self.cells[x] >> 32 == self.cells[x] & 0xFFFFFFFF) | (self.tiles[x] != self.tiles[y])
            kept = tiled & (self.roots[x] != self.roots[y])
            x, y = x[kept], y[kept]
            longer = np.maximum(self.sizes[x], self.sizes[y])
            budget = longer * (100 - percent) // 100
            kept = longer - np.minimum(self.sizes[x], self.sizes[y]) <= budget
            x, y, budget = x[kept], y[kept], budget[kept]
            # A pair belongs to the first blocks that it agrees in.
            agree = (self.blocks[x] == self.blocks[y]) & self.full[x] & self.full[y]
            chosen = choices[self.keys[x] & ((1 << CHOICE_BITS) - 1)]
            inside = np.arange(segments) <= chosen[:, -1:]
            kept = np.take_along_axis(agree, chosen, 1).all(axis=1) & ((agree & inside).sum(axis=1) == agreeing)
            x, y, budget = x[kept], y[kept], budget[kept]
            gap = self.lanes[x] - self.lanes[y]
            kept = np.minimum(gap, -gap).sum(axis=1, dtype=np.int64) <= 2 * budget
            yield from zip(x[kept].tolist(), y[kept].tolist())

    def links(self, rows: int, segments: int, agreeing: int, percent: int) -> pa.RecordBatch:
        """Pairs of the first ``rows`` that are alike, without those that others connect."""
        above: dict[int, int] = {}
        roots, texts, found = self.roots.tolist(), {}, []

        def top(node: int) -> int:
            while (higher := above.get(node, node)) != node:
                above[node] = node = above.get(higher, higher)
            return node

        def joined(x: int, y: int) -> None:
            a, b = top(roots[x]), top(roots[y])
            above[max(a, b)] = min(a, b)
            found.append((x, y))

        open_: list[tuple[int, int, tuple[str, str, int]]] = []

        def settle() -> None:
            left = [row for row in open_ if top(roots[row[0]]) != top(roots[row[1]])]
            open_.clear()
            apart, sure = edit.least_edits([row[2] for row in left])
            for (x, y, (a, b, budget)), edits, known in zip(left, apart.tolist(), sure.tolist()):
                if edits <= budget and top(roots[x]) != top(roots[y]) and (known or edit.distance(a, b, budget) <= budget):
                    joined(x, y)

        for x, y in self.pairs(rows, segments, agreeing, percent):
            if top(roots[x]) == top(roots[y]):
                continue
            for row in (x, y):
                if row not in texts:
                    texts[row] = self.texts[row].as_py()
            near = edit.undecided(texts[x], texts[y], percent)
            if near is True:
                joined(x, y)
            elif near:
                open_.append((x, y, near))
                if len(open_) >= OPEN:
                    settle()
        settle()
        x, y = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(self.nos[x]), pa.array(self.nos[y])], ["a", "b"])


def _alike(rows: DataFrame, spelled: DataFrame, segments: int, agreeing: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` that connect what is alike among the ``rows(key, cell, tile, no, root)`` of each cell of a key.

    A cell is two tiles, whose rows are compared with each other's, or one, whose rows are compared
    among themselves; it is the most that a task holds at once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows < TOGETHER and size < TOGETHER_BYTES:
                continue
            held = [pa.concat_batches(held)]
            compared = _Compared(held[0], segments)
            if compared.last:
                yield compared.links(compared.last, segments, agreeing, percent)
                held = [held[0].slice(compared.last)]
            rows, size = held[0].num_rows, held[0].nbytes
        if held:
            yield _Compared(pa.concat_batches(held), segments).links(rows, segments, agreeing, percent)

    texts = rows.join(spelled, "no").repartition("key", "cell").sortWithinPartitions("key", "cell", "no")
    return texts.mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, spelled: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose lines are similar."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            near = pa.array([edit.alike(a, b, percent) for a, b in rows], pa.bool_())
            yield batch.select([0, 1]).filter(near)

    left = spelled.select(F.col("no").alias("a"), F.col("text").alias("text_a"))
    right = spelled.select(F.col("no").alias("b"), F.col("text").alias("text_b"))
    # A line that very many are compared with is copied for them.
    held = skew.spread(pairs, left, ["a"], ["b"])
    both = skew.spread(held, right, ["b"], ["a"], skew.hot_keys(pairs, ["b"])).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(similar, "a long, b long")


def _tiled(keyed: DataFrame, tile: int) -> DataFrame:
    """The rows of keys once per cell that their tile is in."""
    rows = keyed.withColumn("tile", F.expr(f"slot div {tile}"))
    last = rows.groupBy("key").agg(F.max("tile").alias("last"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other")
    rows = skew.spread(rows, last, ["key"], ["no"]).select("key", "no", "root", "tile", others)
    cell = F.shiftleft(F.least("tile", "other"), 32).bitwiseOR(F.greatest("tile", "other"))
    return rows.select("key", cell.alias("cell"), "tile", "no", "root")


def links(classes: DataFrame, docs: DataFrame, segments: int, agreeing: int, percent: int) -> DataFrame:
    """``(a, b)``: links by which similar ``classes`` are connected."""
    met = scratch.store(_met(classes, segments, agreeing), "keys")
    spelled = scratch.store(_spelled(met.select("no").distinct(), classes, docs), "spelled")
    wide, hot = (scratch.write(met.filter(F.col("slot") == n).select("key"), "hot") for n in (TILE, HOT))
    alone = met.withColumn("root", F.col("no"))
    zero = F.lit(0).cast("long")
    few = skew.attach(alone, wide, ["key"], how="left_anti") if wide.rows else alone
    rows = few.select("key", zero.alias("cell"), zero.alias("tile"), "no", "root")
    if wide.rows:
        many = skew.attach(alone, wide, ["key"])
        rows = rows.unionAll(_tiled(skew.attach(many, hot, ["key"], how="left_anti") if hot.rows else many, TILE))
    linked = scratch.store(_alike(rows, spelled, segments, agreeing, percent), "links")
    if not hot.rows:
        return linked
    lanes = spelled.select("no", "size", "near", "far")
    many = scratch.store(skew.attach(met, hot, ["key"]).join(lanes, "no"), "many")
    compared = None
    for turn in range(STAR_ROUNDS + 1):
        mixed = _mixed_keys(many, components.connected(linked))
        if not mixed.rows:
            break
        if turn == STAR_ROUNDS:
            tiles = _tiled(mixed.df, TILE)
            return linked.unionAll(scratch.store(_alike(tiles, spelled, segments, agreeing, percent), "links"))
        pairs = _star_pairs(mixed.df, percent, turn)
        pairs = scratch.store(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        compared = pairs if compared is None else compared.unionAll(pairs)
        linked = linked.unionAll(scratch.store(_verified(pairs, spelled, percent), "links"))
    return linked


def removed_lines(
    docs: DataFrame, segments: int = SEGMENTS, agreeing: int = AGREEING, percent: int = SIMILAR_PERCENT
) -> DataFrame:
    """``(doc, line_no)`` of each line that repeats, or nearly repeats, a line kept elsewhere.

    ``doc`` is the hash by which ``_identified`` knows a row. Lines connected through others go too.
    """
    found = scratch.store(occurrences(docs, segments), "lines")
    values = ["doc", "line_no", "size", "near", "far", *_blocks(segments)]
    # Of the first row at hand, all of them; the others of a line differ from it in the place only.
    classes = found.groupBy("line").agg(
        F.count(F.lit(1)).alias("n"), *[F.any_value(name).alias(name) for name in values]
    )
    classes = scratch.store(classes.withColumn("no", F.monotonically_increasing_id()), "classes")
    # Shorter lines have only equal ones, as no edit is left even to a longer line.
    long_enough = classes.filter((F.col("size") + 1) * (100 - percent) >= 100)
    roots = components.connected(links(long_enough, docs, segments, agreeing, percent))
    roots = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    grouped = skew.attach(classes.select("no", "line", "n"), roots.withColumnRenamed("node", "no"), ["no"], how="left")
    grouped = grouped.filter("n > 1 or root is not null").select("line", "n", F.coalesce("root", "no").alias("root"))
    grouped = scratch.write(grouped, "groups")
    hot = skew.counted_hot_keys(grouped.df.select("line", "n"), ["line"], "n")
    rows = found.select("doc", "doc_id", "line_no", "line")
    groups = scratch.Written(grouped.df.select("line", "root"), grouped.rows, grouped.bytes)
    members = skew.spread(rows, groups, ["line"], ["doc", "line_no"], hot)
    members = scratch.store(members.select("root", "doc", "doc_id", "line_no"), "members")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "doc", "line_no")
    kept = scratch.write(members.groupBy("root").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n")), "kept")
    hot = skew.counted_hot_keys(kept.df, ["root"], "n")
    places = kept.df.select("root", F.col("kept.doc").alias("kept_doc"), F.col("kept.line_no").alias("kept_no"))
    gone = (F.col("doc") != F.col("kept_doc")) | (F.col("line_no") != F.col("kept_no"))
    found = skew.spread(members, scratch.Written(places, kept.rows, kept.bytes), ["root"], ["doc", "line_no"], hot)
    return found.filter(gone).select("doc", "line_no")


def deduplicate(
    docs: DataFrame, segments: int = SEGMENTS, agreeing: int = AGREEING, percent: int = SIMILAR_PERCENT
) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``cleaned`` text, ``n_lines`` and ``n_removed``.

    Lines without a visible character are kept and never counted. A null text has no lines and
    stays null; empty and very long texts are treated as any other. Rows that agree in id and text
    keep and lose the same lines; rows that share only their id are different documents. Rows without a
    doc_id take part and come after all others: of equal lines, the one of the smallest id stays, then of
    the smallest number. Other columns, of any name, ride along in ``row``. No rows give no rows.
    """
    removed = removed_lines(docs, segments, agreeing, percent)
    gone = removed.groupBy("doc").agg(F.collect_set("line_no").alias("gone"))  # lines of one document
    rows = skew.attach(_identified(docs).select("row", "doc"), gone, ["doc"], how="left").select(
        "row", F.split(F.col("row.text").cast("string"), "\n").alias("lines"), "gone"
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    cleaned = F.when(F.col("gone").isNull(), F.col("row.text").cast("string")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    )
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(
        F.size(F.filter("lines", lambda line: F.ltrim(line, F.lit(_BLANKS)) != ""))
    )
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return rows.select(
        "row", cleaned.alias("cleaned"), n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed")
    )


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_removed, cleaned_sha256)`` per row of ``docs``."""
    return deduplicate(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("cleaned", F.lit("")).cast("binary"), 256).alias("cleaned_sha256"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines removed; documents that lose all their lines go."""
    found = deduplicate(docs).filter("n_removed = 0 or n_removed < n_lines")
    renewed = {"text": F.col("cleaned").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        counted = F.char_length("cleaned").cast(docs.schema["n_chars"].dataType)
        renewed["n_chars"] = F.when(F.col("n_removed") > 0, counted).otherwise(F.col("row.n_chars"))
    return found.select(*[renewed.get(name, F.col("row")[name]).alias(name) for name in docs.columns])
