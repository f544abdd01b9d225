"""Alignment of two tokenizers' tokens by products of sparse incidence matrices.

A token is a row of ones at the bytes it covers. The product of one tokenizer's
matrix with the other's transpose links the tokens that overlap; the same product of
token-by-group matrices links those of one group, a stretch at whose ends both
tokenizers end a token. How many documents hold a pair of ids linked is counted
over the corpus and joined back to each document.
"""

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave import scratch
from evalweave.llm import bpe
from evalweave.operators import skew

# Texts longer than this are encoded in pieces, cut where no token can cross.
PIECE_CHARS = 1 << 16
# Bytes of text whose matrices are multiplied together, and whose pairs share a table.
BATCH_BYTES = 1 << 18
CHUNK_BYTES = 1 << 22
# Encoded parts of texts that a task remembers, and their longest.
REMEMBERED = 400_000
REMEMBERED_LENGTH = 64
_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")
# Letters that every version of Unicode from 10 on files alike.
_SETTLED = regex.compile(
    r"[\t-\r\x20-\x7e\u00a0-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u2010-\u2027\u2030-\u205e"
    r"\u3001-\u3015\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"
)
_SPACED = regex.compile(" +[^ ]*")


@dataclass(frozen=True)
class Csr:
    """A sparse matrix of ones: row ``i`` has ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    def transposed(self) -> "Csr":
        order = np.argsort(self.columns, kind="stable")
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        sizes = np.bincount(self.columns, minlength=self.width)
        return Csr(np.concatenate(([0], np.cumsum(sizes))), rows[order], len(self.starts) - 1)


def product(left: Csr, right: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gustavson's row product: ``(row, column, value)`` of ``left`` times ``right``.

    Every one in a row of ``left`` adds the row of ``right`` it points at; what meets
    in a column is summed.
    """
    sizes = np.diff(right.starts)[left.columns]
    row = np.repeat(np.repeat(np.arange(len(left.starts) - 1), np.diff(left.starts)), sizes)
    skipped = np.cumsum(sizes) - sizes
    place = np.arange(len(row)) + np.repeat(right.starts[left.columns] - skipped, sizes)
    key = row * right.width + right.columns[place]
    key.sort(kind="stable")
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return *np.divmod(key[first], right.width), np.diff(first, append=len(key))


def product_size(left: Csr, right: Csr) -> np.ndarray:
    """Entries in each row of the product, where rows of ``left`` have a single one."""
    return np.diff(right.starts)[left.columns]


class _Encoded(dict):
    """Part of a text to its token ids, as 32-bit little-endian bytes."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        packed = np.array(self.encode(part), dtype="<i4").tobytes()
        if len(part) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = packed
        return packed


class _Bytes:
    """The bytes of every token, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(x) for x in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        skipped = np.cumsum(sizes) - sizes
        return self.flat[np.arange(int(sizes.sum())) + np.repeat(self.starts[ids] - skipped, sizes)]


class Pair:
    """Two tokenizers and the bytes of their tokens, loaded once per worker."""

    def __init__(self, byte_level: str, pieces: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        byte_of = {letter: i for i, letter in enumerate(bpe.byte_letters())}
        vocabulary = {i: token for token, i in self.a.get_vocab().items()}
        self.a_bytes = [
            bytes(byte_of[c] for c in token) if all(map(byte_of.__contains__, token)) else token.encode()
            for token in (vocabulary.get(i, "") for i in range(max(vocabulary) + 1))
        ]
        shown = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(shown)
        ]
        self.a_table, self.b_table = _Bytes(self.a_bytes), _Bytes(self.b_bytes)
        # A token with a space inside could cross a cut.
        self.cuts = not any("▁" in p.lstrip("▁") for p in shown)
        self.a_parts = _Encoded(lambda part: self.a.encode(part, add_special_tokens=False).ids)
        self.b_parts = _Encoded(lambda part: self.b.encode(part[1:], out_type=int))
        self.split = regex.compile(pattern).findall
        # What an id is in the list of groups, followed by what stands after it.
        self.names = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in (",", "|")]
        self.b_from = len(self.names)
        self.names += [f"{i}{end}" for i in range(len(shown)) for end in (",", ";")]
        self.names = np.array(self.names, dtype=object)

    def pieces(self, text: str) -> list[str]:
        """``text`` in parts that both encode alone as they do in it, less the space at each cut."""
        out, begin = [], 0
        while self.cuts and len(text) - begin > PIECE_CHARS:
            cut = _CUT.search(text, begin + PIECE_CHARS)
            if not cut:
                break
            out.append(text[begin : cut.start()])
            begin = cut.end()
        return [*out, text[begin:]]


    def encode_a(self, text: str) -> bytes:
        """Ids of a space and ``text``: part by part where the pattern cuts it as the tokenizer does."""
        text = " " + text
        if _SETTLED.fullmatch(text):
            return b"".join(map(self.a_parts.__getitem__, self.split(text)))
        return np.array(self.a.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def encode_b(self, text: str) -> bytes:
        """Ids of ``text``, to which the tokenizer adds a space: tokens begin at spaces or have none."""
        if self.cuts and not text.endswith(" "):
            return b"".join(map(self.b_parts.__getitem__, _SPACED.findall(" " + text)))
        return np.array(self.b.encode(text, out_type=int), dtype="<i4").tobytes()


@cache
def tokenizers(byte_level: str, pieces: str, pattern: str) -> Pair:
    return Pair(byte_level, pieces, pattern)


@dataclass(frozen=True)
class Aligned:
    """The tokens, groups and links of some pieces, numbered through all of them."""

    good: np.ndarray  # per piece: both give its bytes back
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    cuts: np.ndarray  # the groups' ends
    a_group: np.ndarray
    b_group: np.ndarray
    a_piece: np.ndarray
    b_piece: np.ndarray
    links: tuple[np.ndarray, np.ndarray, np.ndarray]  # a, b, bytes shared


def _same(found: np.ndarray, lengths: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Which pieces are the bytes ``found``, of which each has ``lengths``."""
    want = np.array([len(p) for p in pieces])
    if np.array_equal(lengths, want) and np.array_equal(found, np.frombuffer(b"".join(pieces), np.uint8)):
        return np.ones(len(pieces), dtype=bool)
    ends = np.cumsum(lengths)
    return np.array([found[e - n : e].tobytes() == p for e, n, p in zip(ends, lengths, pieces)], dtype=bool)


def _flat(packed: list[bytes], table: _Bytes, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all pieces, the piece of each, and which pieces the ids give back."""
    ids = np.frombuffer(b"".join(packed), "<i4").astype(np.int64)
    piece = np.repeat(np.arange(len(packed)), [len(x) // 4 for x in packed])
    lengths = np.bincount(piece, table.sizes[ids], minlength=len(packed)).astype(np.int64)
    return ids, piece, _same(table.joined(ids), lengths, pieces)


def _ending(ends: np.ndarray, size: int) -> np.ndarray:
    """Whether a token ends before each byte and at the end."""
    found = np.zeros(size + 1, dtype=bool)
    found[ends] = True
    return found


def align(pair: Pair, pieces: list[str]) -> Aligned:
    """Align non-empty ``pieces``, by themselves and all at once."""
    spaced = [b" " + p.encode() for p in pieces]
    a_ids, a_piece, a_good = _flat(list(map(pair.encode_a, pieces)), pair.a_table, spaced)
    b_ids, b_piece, b_good = _flat(list(map(pair.encode_b, pieces)), pair.b_table, spaced)
    good = a_good & b_good
    if not good.all():
        a_ids, a_piece = a_ids[good[a_piece]], a_piece[good[a_piece]]
        b_ids, b_piece = b_ids[good[b_piece]], b_piece[good[b_piece]]
    a_ends, b_ends = np.cumsum(pair.a_table.sizes[a_ids]), np.cumsum(pair.b_table.sizes[b_ids])
    size = int(a_ends[-1]) if len(a_ends) else 0
    everything = np.arange(size)
    a = Csr(np.concatenate(([0], a_ends)), everything, size)
    b = Csr(np.concatenate(([0], b_ends)), everything, size)
    a_cuts, b_cuts = _ending(b_ends, size)[a_ends], _ending(a_ends, size)[b_ends]
    cuts = a_ends[a_cuts]
    a_group, b_group = np.cumsum(a_cuts) - a_cuts, np.cumsum(b_cuts) - b_cuts
    links = product(a, b.transposed())
    return Aligned(good, a_ids, b_ids, a_ends, b_ends, cuts, a_group, b_group, a_piece, b_piece, links)


def _in_groups(groups: np.ndarray, count: int) -> Csr:
    """Tokens by groups: each token is in one."""
    return Csr(np.arange(len(groups) + 1), groups, count)


def group_links(found: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b) of tokens that share a group."""
    count = len(found.cuts)
    row, column, _ = product(_in_groups(found.a_group, count), _in_groups(found.b_group, count).transposed())
    return row, column


def _listed(pair: Pair, found: Aligned) -> list[str]:
    """Per piece its groups as ``a1,a2|b1;a3|b2,b3;``."""
    a_last = np.diff(found.a_group, append=-1) != 0
    b_last = np.diff(found.b_group, append=-1) != 0
    codes = np.empty(len(found.a_ids) + len(found.b_ids), dtype=np.int64)
    before = np.searchsorted(found.b_group, found.a_group, "left")
    through = np.searchsorted(found.a_group, found.b_group, "right")
    codes[np.arange(len(before)) + before] = 2 * found.a_ids + a_last
    codes[np.arange(len(through)) + through] = pair.b_from + 2 * found.b_ids + b_last
    n = len(found.good)
    sizes = np.bincount(found.a_piece, minlength=n) + np.bincount(found.b_piece, minlength=n)
    names = pair.names[codes].tolist()
    ends = np.cumsum(sizes).tolist()
    return ["".join(names[end - size : end]) for end, size in zip(ends, sizes.tolist())]


@dataclass
class _Document:
    doc_id: int | None
    good: bool = True
    counts: np.ndarray = field(default_factory=lambda: np.zeros(5, dtype=np.int64))
    digest: object = None
    pairs: list = field(default_factory=list)
    times: list = field(default_factory=list)


def _add(pair: Pair, queue: list[tuple[_Document, str]]) -> None:
    """Align the queued pieces and add what they give to their documents."""
    found = align(pair, [piece for _, piece in queue])
    n = len(queue)
    a, b, _ = found.links
    count = len(found.cuts)
    shared = product_size(_in_groups(found.a_group, count), _in_groups(found.b_group, count).transposed())
    last = np.searchsorted(found.a_ends, found.cuts)
    counts = np.stack([
        np.bincount(found.a_piece, minlength=n),
        np.bincount(found.b_piece, minlength=n),
        np.bincount(found.a_piece[last], minlength=n),
        np.bincount(found.a_piece[a], minlength=n),
        np.bincount(found.a_piece, shared, minlength=n).astype(np.int64),
    ], axis=1)
    width = len(pair.a_bytes) * len(pair.b_bytes)
    key = found.a_piece[a] * width + found.a_ids[a] * len(pair.b_bytes) + found.b_ids[b]
    key, times = np.unique(key, return_counts=True)
    cuts = np.searchsorted(key, np.arange(n + 1) * width)
    key %= width
    for i, ((document, _), text) in enumerate(zip(queue, _listed(pair, found))):
        document.good &= bool(found.good[i])
        document.counts += counts[i]
        if document.digest is None:
            document.digest = hashlib.sha256()
        else:
            document.digest.update(b";")
        document.digest.update(text[:-1].encode())
        document.pairs.append(key[cuts[i] : cuts[i + 1]])
        document.times.append(times[cuts[i] : cuts[i + 1]])


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS)]
    + [("groups_sha256", pa.string()), ("slots", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    + [("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
)
_DDL = (
    "chunk long, doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, "
    "slots array<int>, times array<int>, pairs array<long>, docs array<long>"
)


def _chunk_rows(chunk: int, documents: list[_Document]) -> list[pa.RecordBatch]:
    """A row for each document, its pairs as places in a list; and one row with that list."""
    none = np.zeros(0, dtype=np.int64)
    pairs, times = [], []
    for document in documents:
        if not document.good or not document.pairs:
            document.counts[:] = 0
            pairs.append(none)
            times.append(none)
        elif len(document.pairs) == 1:
            pairs.append(document.pairs[0])
            times.append(document.times[0])
        else:
            once, place = np.unique(np.concatenate(document.pairs), return_inverse=True)
            pairs.append(once)
            times.append(np.bincount(place, np.concatenate(document.times)).astype(np.int64))
    table, slots = np.unique(np.concatenate(pairs), return_inverse=True)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in pairs]))).astype(np.int32)
    counts = np.stack([d.counts for d in documents])
    n = len(documents)
    hashes = [d.digest.hexdigest() if d.good and d.digest else "" for d in documents]
    rows = [
        pa.array([chunk] * n, pa.int64()),
        pa.array([d.doc_id for d in documents], pa.int64()),
        *(pa.array(c) for c in counts.T),
        pa.array(hashes),
        pa.ListArray.from_arrays(offsets, pa.array(slots.astype(np.int32))),
        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times).astype(np.int32))),
    ]
    nothing = [pa.nulls(n, t) for t in _SCHEMA.types[-2:]]
    out = [pa.RecordBatch.from_arrays([*rows, *nothing], schema=_SCHEMA)]
    if len(table):
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (table, np.bincount(slots))]
        blank = [pa.nulls(1, t) for t in _SCHEMA.types[1:-2]]
        out.append(pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *blank, *lists], schema=_SCHEMA))
    return out


def _linked(docs: DataFrame, *paths: str) -> DataFrame:
    """Documents and their chunks' lists of id pairs, in one written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(*paths)
        chunk = TaskContext.get().partitionId() << 32
        documents, queue, held, queued = [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                document = _Document(doc_id)
                documents.append(document)
                for piece in pair.pieces(text.as_py() or ""):
                    if piece:
                        queue.append((document, piece))
                        held, queued = held + len(piece), queued + len(piece)
                    if queued >= BATCH_BYTES:
                        _add(pair, queue)
                        queue, queued = [], 0
                if held >= CHUNK_BYTES:
                    if queue:
                        _add(pair, queue)
                    yield from _chunk_rows(chunk, documents)
                    chunk, documents, queue, held, queued = chunk + 1, [], [], 0, 0
        if queue:
            _add(pair, queue)
        if documents:
            yield from _chunk_rows(chunk, documents)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return scratch.store(texts.mapInArrow(work, _DDL), "aligned")


def pair_counts(lists: DataFrame, b_size: int) -> DataFrame:
    """``(pair, count, best)``: documents that hold a pair linked, and whether no pair of the
    same first id is in more. ``lists``: (pair, docs), the documents of one chunk."""
    total = lists.groupBy("pair").agg(F.sum("docs").alias("count"))
    same = Window.partitionBy("a")  # as many rows as the second vocabulary has, at most
    return (
        total.withColumn("a", F.expr(f"pair div {b_size}"))
        .select("pair", "count", (F.col("count") == F.max("count").over(same)).alias("best"))
    )


def agreement(docs: DataFrame, byte_level: str, pieces: str, pattern: str) -> DataFrame:
    """How the tokens of two tokenizers align in every row of ``docs(doc_id, text)``.

    ``byte_level`` (A), whose texts ``pattern`` cuts, encodes a space and the text, ``pieces`` (B)
    the text, both as plain text. Per row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256`` and ``n_group_links``, the pairs that share a group.

    Texts that are null, empty, or that B does not give back byte for byte, have no tokens:
    zeros and an empty digest. Repeated rows and null or repeated ids are rows like others and count as
    documents each. Ties for the highest count are all best. A very long text is encoded
    in pieces; one without a space between two letters is one piece. Other columns are
    not read; no rows give no rows.
    """
    table = _linked(docs, byte_level, pieces, pattern)
    documents = table.filter("n_a is not null").drop("pairs", "docs")
    lists = table.filter("pairs is not null").select(
        "chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("slot", "entry")
    )
    entry = [F.col("entry.pairs").alias("pair"), F.col("entry.docs").alias("docs")]
    lists = lists.select(F.col("chunk").alias("lot"), "slot", *entry)
    size = len(tokenizers(byte_level, pieces, pattern).b_bytes)
    answered = skew.attach(lists, pair_counts(lists, size), ["pair"], ["lot"]).select(
        "lot", "slot", "count", "best"
    )
    kept = ["doc_id", *_COUNTS, "groups_sha256"]

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        slot = right.column("slot").to_numpy()
        count, best = np.zeros((2, len(slot)), dtype=np.int64)
        count[slot] = right.column("count").to_numpy()
        best[slot] = right.column("best").to_numpy()
        slots = left.column("slots").combine_chunks()
        offsets = slots.offsets.to_numpy() - slots.offsets[0].as_py()
        place, times = slots.flatten().to_numpy(), left.column("times").combine_chunks().flatten().to_numpy()
        sums = [np.concatenate(([0], np.cumsum(x[place] * times)))[offsets] for x in (best, count)]
        out = left.select(kept)
        for name, total in zip(("n_best", "count_sum"), sums):
            out = out.append_column(name, pa.array(np.diff(total)))
        return out

    schema = (
        "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, "
        "n_best long, count_sum long"
    )
    found = documents.groupBy("chunk").cogroup(answered.groupBy("lot")).applyInArrow(summed, schema)
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"
    )


def spans(docs: DataFrame, *paths: str) -> DataFrame:
    """The alignment itself, for every piece of every row of ``docs(doc_id, text)``.

    ``(doc_id, piece, a_ids, a_ends, b_ids, b_ends, group_ends, link_a, link_b, shared,
    group_a, group_b)``: token ids, their ends in bytes of a space and the piece, the ends
    of the groups, the overlapping tokens with the bytes they share, and the tokens that
    share a group. Texts without tokens, as in :func:`agreement`, give one piece of empty lists.
    """
    names = ["a_ids", "a_ends", "b_ids", "b_ends", "group_ends", "link_a", "link_b", "shared", "group_a", "group_b"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((x, pa.list_(pa.int64())) for x in names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(*paths)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = pair.pieces(text.as_py() or "")
                found = [align(pair, [p]) for p in parts] if parts != [""] else []
                if not all(f.good.all() for f in found):
                    found = []
                rows = [
                    (doc_id, i, f.a_ids, f.a_ends, f.b_ids, f.b_ends, f.cuts, *f.links, *group_links(f))
                    for i, f in enumerate(found)
                ]
                rows = rows or [(doc_id, 0, *[[]] * len(names))]
                arrays = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ddl = "doc_id long, piece int, " + ", ".join(f"{x} array<long>" for x in names)
    return texts.mapInArrow(work, ddl)
