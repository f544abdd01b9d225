"""Stupid-backoff scores of documents from n-gram count tables.

Texts are packed into chunks. Each chunk asks for the counts of its distinct
n-grams: one request per range of n-gram hashes, so the count tables are spread by
hash and an n-gram that every document has is one entry per chunk. The counts go
back to the chunk, are joined to its n-grams and summed per document.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave import scratch

ORDER = 2
BACKOFF = 0.4
# N-grams of two words or more count as unseen below this.
MIN_COUNT = 2
CHUNK_BYTES = 8 * 1024 * 1024
# Text whose n-grams one range of hashes gets, about.
RANGE_BYTES = 16 * 1024 * 1024
# Word hashes remembered by a task.
REMEMBERED = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _packed(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """``(chunk, size, ids, known, lengths, texts)``: documents in compressed chunks."""
    names = ["chunk", "size", "ids", "known", "lengths", "texts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            values = [
                (task << 32) + number,
                size,
                np.array([i or 0 for i in ids], np.int64).tobytes(),
                np.array([i is not None for i in ids], np.uint8).tobytes(),
                np.array([len(t) for t in texts], np.int64).tobytes(),
                zstandard.compress(b"".join(texts), 3),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(doc_id)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield flush()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "chunk long, size long, ids binary, known binary, lengths binary, texts binary"
    return rows.mapInArrow(work, schema)


def _grams(row, order: int, words: _Words) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words per document, and by length the n-gram hash that ends at each word.

    The third array says how many words stand before a word in its document.
    """
    joined = zstandard.decompress(row["texts"]) if row["size"] else b""
    sizes, parts, at = [], [], 0
    for length in np.frombuffer(row["lengths"], np.int64).tolist():
        tokens = joined[at : at + length].lower().split()
        parts.append(np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens)))
        sizes.append(len(tokens))
        at += length
    sizes = np.array(sizes, np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    before = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = [flat]
    for n in range(1, order):
        longer = grams[-1].copy()
        longer[n:] = (grams[-1][n - 1 : -1] * _MIX) ^ flat[n:]
        longer = (longer ^ (longer >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        longer ^= longer >> np.uint64(29)
        grams.append(longer)
    return sizes, grams, before


def _distinct(grams: list[np.ndarray], before: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """By length: distinct hashes, the place of each n-gram among them, and counts."""
    return [
        np.unique(gram[before >= n], return_inverse=True, return_counts=True)
        for n, gram in enumerate(grams)
    ]


def _cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted ``hashes`` pass from one range to the next."""
    borders = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, borders), [len(hashes)]])


def _squeeze(sorted_hashes: np.ndarray) -> bytes:
    """Gaps, byte by byte of the same weight: what sorted hashes share costs nothing."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unsqueeze(blob: bytes) -> np.ndarray:
    columns = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(columns.T).view("<u8").reshape(-1), dtype=np.uint64)


def _requests(chunks: DataFrame, order: int, ranges: int) -> DataFrame:
    """``(n, part, chunk, hashes, counts)``: distinct n-grams of a chunk in one range of hashes."""
    names = ["n", "part", "chunk", "hashes", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                _, grams, before = _grams(row, order, words)
                for n, (hashes, _, counts) in enumerate(_distinct(grams, before)):
                    cuts = _cuts(hashes, ranges)
                    full = np.flatnonzero(np.diff(cuts)).tolist()
                    pieces = [slice(cuts[i], cuts[i + 1]) for i in full]
                    columns = [
                        pa.array([n] * len(full), pa.int32()),
                        pa.array(full, pa.int32()),
                        pa.array([row["chunk"]] * len(full), pa.int64()),
                        pa.array([_squeeze(hashes[p]) for p in pieces], pa.binary()),
                        pa.array(
                            [zstandard.compress(counts[p].astype("<u4").tobytes(), 1) for p in pieces],
                            pa.binary(),
                        ),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return chunks.mapInArrow(work, "n int, part int, chunk long, hashes binary, counts binary")


def _replies(requests: DataFrame) -> DataFrame:
    """``(chunk, n, part, counts)``: corpus counts in the order of each request's hashes."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        hashes = [_unsqueeze(blob) for blob in group["hashes"]]
        counts = [np.frombuffer(zstandard.decompress(blob), "<u4") for blob in group["counts"]]
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(distinct)).astype("<i8")
        replies = np.split(total[place], np.cumsum([len(h) for h in hashes])[:-1])
        packed = [zstandard.compress(reply.tobytes(), 1) for reply in replies]
        return group[["chunk", "n", "part"]].assign(counts=packed)

    return requests.groupBy("n", "part").applyInPandas(count, "chunk long, n int, part int, counts binary")


def _scored(chunks: DataFrame, replies: DataFrame, order: int, words_total: int, min_count: int) -> DataFrame:
    def score(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        sizes, grams, before = _grams(row, order, _Words())
        tables = []
        for n, (hashes, place, _) in enumerate(_distinct(grams, before)):
            mine = answers[answers["n"] == n].sort_values("part")
            counts = np.concatenate(
                [np.frombuffer(zstandard.decompress(b), "<i8") for b in mine["counts"]] or [np.zeros(0, np.int64)]
            )
            spread = np.zeros(len(before), np.int64)
            spread[before >= n] = counts[place]
            tables.append(spread)
        # From single words up: the longest n-gram that is known decides.
        value = np.log10(tables[0] / max(1, words_total))
        length = np.ones(len(before), np.int64)
        for n in range(1, order):
            here = before >= n
            context = np.concatenate([[0], tables[n - 1][:-1]])[: len(before)]
            known = here & (tables[n] >= min_count)
            value = np.where(here, value + np.log10(BACKOFF), value)
            with np.errstate(divide="ignore"):
                value = np.where(known, np.log10(tables[n] / np.maximum(1, context)), value)
            length = np.where(known, n + 1, length)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ids = pd.array(np.frombuffer(row["ids"], np.int64), dtype="Int64")
        ids[np.frombuffer(row["known"], np.uint8) == 0] = pd.NA
        return pd.DataFrame(
            {
                "doc_id": ids,
                "n_words": sizes,
                "n_longest": np.bincount(owner[length == order], minlength=len(sizes)),
                "score": np.bincount(owner, value, len(sizes)),
            }
        )

    return (
        chunks.groupBy("chunk")
        .cogroup(replies.groupBy("chunk"))
        .applyInPandas(score, "doc_id long, n_words long, n_longest long, score double")
    )


def score(
    docs: DataFrame,
    order: int = ORDER,
    min_count: int = MIN_COUNT,
    chunk_bytes: int = CHUNK_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``(doc_id, n_words, n_longest, score, mean_score)`` for every row of ``docs``.

    Words are runs between ASCII white space, A-Z lower-cased. The counts are of all
    documents. ``score`` sums log10 S over a document's words: S is the share of an
    n-gram in its context's count if the n-gram is known (``min_count`` times or
    more), else 0.4 times S of the n-gram one word shorter; a single word's S is
    its share of all words. ``n_longest`` words were scored at the full ``order``.
    A null or empty text has no words, score 0 and a null mean. Repeated rows are
    counted and scored each; null ids are kept; other columns are not read; an
    empty table gives no rows. N-grams are told apart by 64-bit hashes.
    """
    chunks = scratch.store(_packed(docs, chunk_bytes), "chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, -(-size // range_bytes))
    replies = scratch.store(_replies(_requests(chunks, order, ranges)), "counts")
    # Single words are counted once per chunk and word: their sum is the corpus' length.
    total = _length(chunks)
    scored = _scored(chunks, replies, order, total, min_count)
    return scored.withColumn(
        "mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words"))
    )


def _length(chunks: DataFrame) -> int:
    """Words of all chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                joined = zstandard.decompress(row["texts"]) if row["size"] else b""
                at, words = 0, 0
                for length in np.frombuffer(row["lengths"], np.int64).tolist():
                    words += len(joined[at : at + length].split())
                    at += length
                found.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["words"])

    counted = chunks.select("size", "lengths", "texts").mapInArrow(work, "words long")
    return counted.agg(F.sum("words")).first()[0] or 0
