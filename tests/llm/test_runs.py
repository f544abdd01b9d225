"""Periodic runs beside a search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.llm import queries, runs

DOCS = "doc_id long, text string, row string, runs int, period string, words long"


def all_runs(words):
    """Every maximal stretch with its smallest period, by comparing all words at all periods."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        start = None
        for i in range(len(words) - p + 1):
            same = i + p < len(words) and words[i] == words[i + p]
            if same and start is None:
                start = i
            elif not same and start is not None:
                length = i + p - start
                if length >= max(24, 3 * p):
                    found.setdefault((start, length), p)
                start = None
    return sorted((s, n, p) for (s, n), p in found.items())


def plain(doc_id, text):
    """The registered row of one text, written as its definition reads."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    milli = 1000 * top[1] // top[2] if found else None
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    return (doc_id, len(found), *top, milli, *digest)


def made(seed):
    """Random words with repeats of random periods put in, some inside others."""
    rng = random.Random(seed)
    words = [rng.choice("abcdefghij") for _ in range(rng.randrange(0, 700))]
    for _ in range(rng.randrange(0, 4)):
        period = [rng.choice("ab cd e".split()) for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 31, 40, 64, 100]))]
        block = period * rng.randrange(2, 6) + period[: rng.randrange(0, len(period))]
        if rng.random() < 0.3:
            block = (block + ["z"]) * 4
        at = rng.randrange(0, len(words) + 1)
        words[at:at] = block
    return " ".join(words)


TEXTS = [
    (1, None), (2, ""), (3, " \n\t\x0b "), (4, "x " * 23), (5, "x " * 24), (6, "x\ty\n" * 2000),
    (7, "same text"), (7, "other text"), (7, "other text"), (None, "a b c " * 30), (None, None),
    (8, "w" * 60_000), (9, " ".join(f"w{i % 997}" for i in range(5000))), (10, "  é 東京 🙂 " * 9),
    (11, " ".join(["a"] * 30 + ["b"] + ["a"] * 30)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*TEXTS, *((100 + i, made(i)) for i in range(160))]
    return spark.createDataFrame([(i, t, "r", 1, "p", 5) for i, t in rows], DOCS).repartition(3).cache()


def order(row):
    return tuple((x is None, x) for x in row)


def test_equals_every_period(docs):
    got = [tuple(r) for r in runs.digests(queries.repeating(docs)).collect()]
    want = [plain(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(r[1] > 1 for r in want) > 20


def test_runs_and_texts(docs):
    for row in runs.collapse(docs.filter("doc_id in (5, 9, 11)")).collect():
        if row.doc_id == 5:
            assert [tuple(r) for r in row.runs] == [(0, 24, 1)] and row.collapsed == "x"
        elif row.doc_id == 9:
            assert [tuple(r) for r in row.runs] == [(0, 5000, 997)] and row.collapsed.count(" ") == 996
        else:
            assert [r.start for r in row.runs] == [0, 31] and row.collapsed == "a b a"


def test_no_rows(spark):
    found = runs.digests(spark.createDataFrame([], DOCS))
    assert found.count() == 0
    assert found.columns[:3] == ["doc_id", "n_runs", "start"]


def test_small_pieces_number_alike(monkeypatch):
    text = made(3).encode()
    whole = runs.numbered(text)
    monkeypatch.setattr(runs, "SPLIT_BYTES", 7)
    assert np.array_equal(runs.numbered(text), whole)


def test_registered_query_equals_every_period(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect())
    rows = queries.table(spark, sf, "documents").select(F.col("doc_id"), "text").collect()
    assert got == sorted(plain(*r) for r in rows)
