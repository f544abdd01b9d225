"""Toxicity scores by a factorization machine over hashed terms.

Besides a weight, every term has a small vector; the products of vectors give each
pair of terms a weight of its own, so an insult next to a group's name can count
for more than both alone. The model is fitted on a bounded sample of labelled
documents, in one task, and scores all documents in place.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bound of the fitting sample: labelled documents, drawn by a hash of their id.
TRAIN_ROWS = 20_000
TERM_BITS = 18
FACTORS = 4
EPOCHS = 10
BATCH = 64
RATE = 0.1
VECTOR_RATE = 0.02
DECAY = 0.002
# A toxic document weighs as much as this many others.
TOXIC_WEIGHT = 2.0
# Terms get a weight if this many toxic documents of the sample have them, and their
# share of toxic documents is so many standard errors from that of all.
MIN_DOCUMENTS = 5
MIN_ERRORS = 5.0
# Word hashes remembered by a task.
REMEMBERED = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")


class _Terms(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh32_intdigest(word.encode()) >> (32 - TERM_BITS)
        return value


def terms(text: str, known: _Terms) -> list[int]:
    """The distinct hashed words of a text."""
    return list({known[word] for word in set(_WORD.findall(text.lower()))})


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((t for row in rows for t in row), np.int64, int(sizes.sum()))
    return flat, np.repeat(np.arange(len(rows)), sizes)


class Machine:
    """bias + term weights + pair weights; a document's terms count once each."""

    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def margins(self, flat: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(owner, self.weights[flat], rows)
        sums, squares = np.empty((rows, FACTORS)), np.zeros(rows)
        for k in range(FACTORS):
            v = self.vectors[flat, k]
            sums[:, k] = np.bincount(owner, v, rows)
            squares += np.bincount(owner, v * v, rows)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, rows: list) -> np.ndarray:
        flat, owner = _flat(rows)
        margin, _ = self.margins(flat, owner, len(rows))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def packed(self) -> bytes:
        parts = [np.array([self.bias]), self.weights, self.vectors.reshape(-1)]
        return np.concatenate(parts).astype("<f4").tobytes()

    @classmethod
    def unpacked(cls, blob: bytes) -> "Machine":
        values = np.frombuffer(blob, "<f4").astype(np.float64)
        size = 1 << TERM_BITS
        return cls(values[0], values[1 : size + 1], values[size + 1 :].reshape(size, FACTORS))


def telling(rows: list, labels: np.ndarray) -> np.ndarray:
    """Which terms go with one label more than chance would have it."""
    size = 1 << TERM_BITS
    seen = np.bincount(_flat(rows)[0], minlength=size)
    toxic = np.bincount(_flat([r for r, label in zip(rows, labels) if label])[0], minlength=size)
    share = labels.mean() if len(labels) else 0.0
    spread = np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    return (toxic >= MIN_DOCUMENTS) & (np.abs(toxic - seen * share) >= MIN_ERRORS * spread)


def fitted(rows: list, labels: np.ndarray) -> Machine:
    """A machine fitted by adaptive gradient steps on the logistic loss."""
    size = 1 << TERM_BITS
    random = np.random.default_rng(7)
    allowed = telling(rows, labels)
    rows = [[t for t in row if allowed[t]] for row in rows]
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)))
    machine.vectors[allowed] = random.normal(0, 0.01, (int(allowed.sum()), FACTORS))
    squared_w, squared_v = np.ones(size), np.ones((size, FACTORS))
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            chosen = order[start : start + BATCH]
            flat, owner = _flat([rows[i] for i in chosen])
            margin, sums = machine.margins(flat, owner, len(chosen))
            wrong = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]
            wrong *= np.where(labels[chosen] > 0, TOXIC_WEIGHT, 1.0)
            used, place = np.unique(flat, return_inverse=True)
            pull = wrong[owner]
            step = np.bincount(place, pull, len(used)) + DECAY * machine.weights[used]
            squared_w[used] += step**2
            machine.weights[used] -= RATE * step / np.sqrt(squared_w[used])
            for k in range(FACTORS):
                vector = machine.vectors[flat, k]
                slope = pull * (sums[owner, k] - vector)
                step = np.bincount(place, slope, len(used)) + DECAY * machine.vectors[used, k]
                squared_v[used, k] += step**2
                machine.vectors[used, k] -= VECTOR_RATE * step / np.sqrt(squared_v[used, k])
            machine.bias -= 0.1 * RATE * wrong.mean()
    return machine


def held_out(doc_id: Column) -> Column:
    """One document in five, by a checksum of its id, never taken for fitting."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``(doc_id, toxic, terms)`` of at most ``rows`` labelled documents."""
    named = (
        labels.filter("doc_id is not null and toxic is not null")
        .filter(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms()
        for batch in batches:
            found = [sorted(terms(t or "", known)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                ["doc_id", "toxic", "terms"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(named), "doc_id").select("doc_id", "toxic", "text")
    return joined.mapInArrow(work, "doc_id long, toxic int, terms array<int>").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on ``labels(doc_id, toxic)`` of documents that are not held out."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        return pd.DataFrame({"model": [fitted(list(group["terms"]), group["toxic"].to_numpy(float)).packed()]})

    sample = _sample(docs, labels, rows).withColumn("one", F.lit(1))
    model = sample.groupBy("one").applyInPandas(work, "model binary").first()
    return Machine.unpacked(bytes(model["model"])) if model else fitted([], np.zeros(0))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``, from its whole text.

    A null or empty text has no terms and gets the bias' score. A null id is not
    held out. Repeated rows are each scored; other columns are not read; an empty
    table gives no rows.
    """
    blob = machine.packed()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = _Terms(), Machine.unpacked(blob)
        for batch in batches:
            rows = [terms(t or "", known) for t in batch.column(1).to_pylist()]
            scores = model.scores(rows)
            columns = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, score double, predicted int"
    )
    is_held_out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", is_held_out.alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the labelled documents that are not held out, score all of them."""
    return score(docs, fit(docs, labels, rows))
