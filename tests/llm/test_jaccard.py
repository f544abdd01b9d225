"""The n-gram join beside a comparison of all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evalweave.llm import jaccard, queries

DOCS = "doc_id long, text string, doc string, n int, token string, root long"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < 3:
        return frozenset([tuple(words)])
    return frozenset(zip(words, words[1:], words[2:]))


def linked(x, y):
    return bool(x) and 100 * len(x & y) >= 90 * len(x | y)


def plain(rows):
    """Components of all rows by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if top(i) != top(j) and linked(sets[i], sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(top(i))) for i, (doc_id, _) in enumerate(rows)]


def made(seed=5):
    """Prose with families of near copies, some at the limit, and passages many texts share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(120)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\ttwo"), (8, "two one")]
    rows += [(9, "same row again"), (9, "same row again"), (9, "other row again"), (None, "no id at all"), (None, None)]
    rows += [(20, "no id\nAT all"), (21, "x " * 500), (22, "x " * 900), (23, "é É é É"), (24, "é é é é")]
    for i in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 60, 61, 100, 400]))]
        if i % 3 == 0:
            at = rng.randrange(len(base))
            base[at:at] = passage[: rng.choice([40, 120])]
        for j in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(50)}"
            rows.append((100 + 20 * i + j, " ".join(copy)))
    rows += [(2000 + i, " ".join(passage[: 100 + i])) for i in range(21)]
    return rows


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "d", 1, "t", 2) for i, t in ROWS]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def order(row):
    return tuple((x is None, x) for x in row)


def same(got, want):
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_equals_all_pairs(docs):
    want = plain(ROWS)
    same(jaccard.connected(docs).collect(), want)
    sizes = [c for _, n, c in want if n > 20]
    assert 10 < len(set(sizes)) < len(sizes) - 20


def test_equals_all_pairs_salted_without_stars(docs, salted, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 1)
    monkeypatch.setattr(jaccard, "star_pairs", lambda table, percent, turn: table.selectExpr("doc a", "doc b").limit(0))
    same(jaccard.connected(docs).collect(), plain(ROWS))


def test_every_link_once(docs):
    rows, found = jaccard.links(docs)
    sets = {}
    for text in {t for _, t in ROWS if grams(t)}:
        (hashes,) = jaccard.shingles([text.encode()], 3)
        sets[xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)] = grams(text)
    assert {r.doc for r in rows.collect()} - {None} == set(sets)
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and linked(sets[a], sets[b])}
    listed = [(*sorted((r.a, r.b)), r.shared) for r in found.collect()]
    assert sorted(listed) == sorted((*p, n) for p, n in want.items()) and len(want) > 20


def test_links_share_a_prefix():
    rng = random.Random(3)
    places = np.arange(1 << jaccard.SKETCH_BITS, dtype=np.uint32)
    tried = 0
    for text in [t for _, t in ROWS if t] * 3:
        words = text.split()
        if len(words) < 40:
            continue
        words[rng.randrange(len(words))] = "changed"
        both = [text.encode(), " ".join(words).encode()]
        x, y = (jaccard.ordered(grams, places) for grams in jaccard.shingles(both, 3))
        if 100 * len(np.intersect1d(x, y)) < 90 * len(np.union1d(x, y)):
            continue
        heads = [k[: jaccard.prefix_size(len(k), 90)] for k in (x, y)]
        common = np.intersect1d(*heads)
        assert len(common)
        tried += 1
    assert tried > 20


@pytest.mark.parametrize("size", [8, 40, 1 << 18])
def test_words_hash_alike_wherever_they_stand(monkeypatch, size):
    """Equal n-grams have equal hashes, different ones different, also over the ends of buffers."""
    monkeypatch.setattr(jaccard, "BUFFER_BYTES", size)
    jaccard._powers.cache_clear()
    texts = [t or "" for _, t in ROWS]
    names = {}
    for text, hashes in zip(texts, jaccard.shingles([t.encode() for t in texts], 3), strict=True):
        assert len(hashes) == len(grams(text))
        for gram, hashed in zip(sorted(grams(text)), sorted(hashes.tolist())):
            names.setdefault(len(gram), set()).add(hashed)
    assert {n: len(x) for n, x in names.items()} == {
        n: len({g for t in texts for g in grams(t) if len(g) == n}) for n in names
    }
    jaccard._powers.cache_clear()


def test_one_order_for_all():
    places = np.random.default_rng(1).permutation(1 << jaccard.SKETCH_BITS).astype(np.uint32)
    grams_ = np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)
    keys = jaccard.ordered(grams_, places)
    assert len(np.unique(keys)) == len(np.unique(grams_))
    assert set(jaccard.ordered(grams_[:50], places)) <= set(keys)


def test_no_rows(spark):
    found = jaccard.connected(spark.createDataFrame([], DOCS))
    assert found.count() == 0 and found.columns == ["doc_id", "n_shingles", "component_id"]


def test_registered_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select(F.col("doc_id"), "text").collect()]
    same(queries.op12_ngram_jaccard_join(spark, sf).collect(), plain(rows))
