"""Token alignment beside loops over all tokens and bytes."""

import collections
import hashlib

import numpy as np
import pytest

from evalweave.llm import alignment, queries

DOCS = "doc_id long, text string, chunk string, count int, pair string, slots long"
PATHS = queries.tokenizer_pair()
LETTERS = "Ēauou nerthering, the ofly! 東京 🙂 naïve"
TEXTS = [
    (1, None), (2, ""), (3, "a"), (4, " "), (5, "  two  spaces \n\n\tand tabs"), (6, "▁ mark"),
    (7, "<|endoftext|> <s> <unk> <0x41> it's"), (8, "東京タワー 🙂🙃 é é ​ ﷽"), (9, "the the the the"),
    (10, "same row"), (10, "same row"), (10, "other row"), (None, "no id"), (None, None),
    (11, "x" * 3000), (12, "nul \x00 \x7f ﻿ end"), (13, LETTERS), (14, "12345 67.89 -- ---- ======== "),
    (15, (LETTERS + " ") * 80),
]


def tokens(pair, text):
    """``[(id, bytes)]`` of both, empty if either differs from the text."""
    if not text:
        return [], []
    a = [(i, pair.a_bytes[i]) for i in pair.a.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, pair.b_bytes[i]) for i in pair.b.encode(text, out_type=int)]
    want = b" " + text.encode()
    return (a, b) if all(b"".join(x for _, x in side) == want for side in (a, b)) else ([], [])


def covered(side):
    """The token at each byte."""
    return [place for place, (_, x) in enumerate(side) for _ in x]


def plain(rows):
    pair = alignment.tokenizers(*PATHS)
    held, counts = [], collections.Counter()
    for doc_id, text in rows:
        a, b = tokens(pair, text)
        at_a, at_b = covered(a), covered(b)
        links = {(x, y) for x, y in zip(at_a, at_b)}
        both = [i for i in range(len(at_a)) if i + 1 == len(at_a) or (at_a[i] != at_a[i + 1] and at_b[i] != at_b[i + 1])]
        groups, begin = [], 0
        for end in both:
            sides = [sorted(set(at[begin : end + 1])) for at in (at_a, at_b)]
            groups.append((sides[0], sides[1]))
            begin = end + 1
        ids = [(a[x][0], b[y][0]) for x, y in links]
        counts.update(set(ids))
        held.append((doc_id, a, b, groups, ids))
    best = collections.defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, a, b, groups, ids in held:
        listed = ";".join(
            ",".join(str(a[x][0]) for x in left) + "|" + ",".join(str(b[y][0]) for y in right) for left, right in groups
        )
        digest = hashlib.sha256(listed.encode()).hexdigest() if a else ""
        n_best = sum(counts[p] == best[p[0]] for p in ids)
        within = sum(len(left) * len(right) for left, right in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(ids), n_best, sum(counts[p] for p in ids), digest, within))
    return out


def order(row):
    return tuple((x is None, x) for x in row)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "c", 1, "p", 2) for i, t in TEXTS], DOCS).repartition(3).cache()


def test_equals_loops(docs):
    got = [tuple(r) for r in alignment.agreement(docs, *PATHS).collect()]
    assert sorted(got, key=order) == sorted(plain(TEXTS), key=order)
    assert {r[0]: r[1] for r in got}[6] == 0 and {r[0]: r[1] for r in got}[15] > 1000


def test_equals_loops_in_small_lots_and_salted(docs, salted, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 20)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 60)
    got = [tuple(r) for r in alignment.agreement(docs, *PATHS).collect()]
    assert sorted(got, key=order) == sorted(plain(TEXTS), key=order)


def test_pieces_encode_as_the_whole(monkeypatch):
    pair = alignment.tokenizers(*PATHS)
    text = (LETTERS + " it's 12 a b\n c ") * 40
    monkeypatch.setattr(alignment, "PIECE_CHARS", 30)
    parts = pair.pieces(text)
    assert len(parts) > 20 and " ".join(parts) == text
    whole = tokens(pair, text)
    assert [sum((tokens(pair, p)[side] for p in parts), []) for side in (0, 1)] == list(whole)


def test_parts_encode_as_the_whole(spark):
    """Remembered parts give the ids that both tokenizers give the whole text."""
    pair = alignment.tokenizers(*PATHS)
    rows = queries.table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()
    for text in [*(t for _, t in TEXTS), *(r.text for r in rows)]:
        if text:
            got = [np.frombuffer(x, "<i4").tolist() for x in (pair.encode_a(text), pair.encode_b(text))]
            assert got[0] == pair.a.encode(" " + text, add_special_tokens=False).ids
            assert got[1] == pair.b.encode(text, out_type=int)


def test_a_text_of_many_pieces_counts_once(spark, monkeypatch):
    text = (LETTERS + " ") * 3000
    assert len(alignment.tokenizers(*PATHS).pieces(text)) > 1
    rows = [(1, text), (2, LETTERS)]
    got = [tuple(r) for r in alignment.agreement(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect()]
    assert sorted(got) == plain(rows)


def test_product_equals_dense():
    rng = np.random.default_rng(1)
    for _ in range(20):
        left, right = rng.integers(0, 2, (5, 7)), rng.integers(0, 2, (7, 4))

        def sparse(dense):
            starts = np.concatenate(([0], np.cumsum(dense.sum(axis=1))))
            return alignment.Csr(starts, np.nonzero(dense)[1], dense.shape[1])

        dense = np.zeros((5, 4), dtype=int)
        row, column, value = alignment.product(sparse(left), sparse(right))
        dense[row, column] = value
        assert (dense == left @ right).all()
        row, column, value = alignment.product(sparse(left), sparse(left).transposed())
        assert (value == (left @ left.T)[row, column]).all()


def test_spans(docs):
    pair = alignment.tokenizers(*PATHS)
    for row in alignment.spans(docs.filter("doc_id in (1, 6, 8, 13)"), *PATHS).collect():
        a, b = tokens(pair, dict(TEXTS)[row.doc_id])
        assert row.a_ids == [i for i, _ in a] and row.b_ids == [i for i, _ in b]
        assert sum(row.shared) == sum(len(x) for _, x in a)
        assert set(zip(row.link_a, row.link_b)) == set(zip(covered(a), covered(b)))
        assert set(zip(row.link_a, row.link_b)) <= set(zip(row.group_a, row.group_b))


def test_no_rows(spark):
    found = alignment.agreement(spark.createDataFrame([], DOCS), *PATHS)
    assert found.count() == 0 and found.columns[0] == "doc_id"


def test_registered_query_equals_loops(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op13_token_alignment(spark, sf).collect()) == sorted(plain(rows))
