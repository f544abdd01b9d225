"""What tasks hold and do, beside what they return."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from evalweave.llm import bits, edit, lines, simhash


class _Caught:
    """Takes the place of a table and keeps the function that its batches would go through."""

    def select(self, *columns):
        return self

    def mapInArrow(self, work, schema):
        self.work = work
        return self


def test_fingerprints_hold_the_shingles_of_few_rows(spark):
    """The hashes of 4,000 rows of 300 words alone would take 40 MB as Python's numbers."""
    draw = random.Random(3)
    texts = [" ".join(str(draw.random()) for _ in range(300)) for _ in range(400)] * 10
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "mark", "text"])
    work = simhash.fingerprints(_Caught()).work
    tracemalloc.start()
    found = pa.Table.from_batches(work(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16_000_000
    assert found["doc_id"].to_pylist() == ids.to_pylist()
    rows = found["fp"].to_pylist()
    assert rows == rows[:400] * 10 and len(set(rows)) == 400


def _classes(spark, lines_in):
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines_in)], "doc_id long, text string")
    return lines.occurrences(docs).withColumnRenamed("doc_id", "no")


def _words(draw, n):
    return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


def test_only_lines_that_share_blocks_have_keys(spark, monkeypatch):
    draw = random.Random(4)
    alone = [_words(draw, 40) for _ in range(60)]
    near = _words(draw, 40)
    made = []
    keyed = lines._keyed

    def counted(classes, segments, agreeing):
        rows = keyed(classes, segments, agreeing)
        made.append((agreeing, rows.select("no").distinct().count()))
        return rows

    monkeypatch.setattr(lines, "_keyed", counted)
    lines._met(_classes(spark, [*alone, near, near + " more"]), lines.SEGMENTS, lines.AGREEING).count()
    assert [n for agreeing, n in made if agreeing == lines.AGREEING] == [2]


@pytest.mark.parametrize("agreeing", [1, 2, 3])
def test_met_has_every_key_that_two_lines_have(spark, agreeing):
    draw = random.Random(5)
    some = [_words(draw, n) for n in (3, 4, 6, 7, 12, 30) for _ in range(6)]
    changed = [" ".join(w for i, w in enumerate(line.split()) if i != draw.randrange(12)) for line in some * 3]
    classes = _classes(spark, [*some, *changed, "", "a", "!"]).cache()
    rows = [tuple(row) for row in lines._keyed(classes, lines.SEGMENTS, agreeing).collect()]
    keys = [key for key, _ in rows]
    wanted = sorted(row for row in rows if keys.count(row[0]) > 1)
    met = [tuple(row) for row in lines._met(classes, lines.SEGMENTS, agreeing).collect()]
    assert wanted and sorted(row[:2] for row in met) == wanted
    slots = {}
    for key, _, slot in met:
        slots.setdefault(key, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


class _Counting(dict):
    looked = 0

    def get(self, *args):
        self.looked += 1
        return super().get(*args)


def test_texts_too_far_apart_are_not_compared_to_their_end():
    draw = random.Random(6)
    a, b = (_words(draw, 150) for _ in range(2))
    masks = _Counting(edit.letter_masks(a))
    assert edit._whole(masks, len(a), b, len(a) // 5) > len(a) // 5
    assert masks.looked < 0.6 * len(b)


def test_budgets_end_with_the_distance_or_more_than_the_budget():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    draw = random.Random(7)
    for _ in range(60):
        a = [draw.choice("ab cdß漢𝒳") for _ in range(draw.choice([1, 64, 130, 200, 300]))]
        b = [draw.choice("abc") if draw.random() < 0.2 else x for x in a if draw.random() < 0.9]
        a, b = "".join(a), "".join(b)
        edits, budget = plain(a, b), draw.randrange(120)
        found = edit.distance(a, b, budget)
        assert edit.distance(a, b) == edits
        assert found == edits if edits <= budget else budget < found <= edits


def test_unlike_texts_are_told_apart_by_their_begins(monkeypatch):
    """No text is read to its end to see that it is over its budget, if many are compared together."""
    draw = random.Random(8)
    pairs = [tuple("".join(draw.choices("abcdefghij klñ日", k=draw.randrange(300, 360))) for _ in "ab") for _ in range(200)]
    near = [(a, a[:150] + "x" + a[151:]) for a, _ in pairs[:50]]
    monkeypatch.setattr(edit, "distance", None)
    found, sure = edit.least_edits([(a, b, 60) for a, b in pairs + near])
    assert sure[:200].all() and (found[:200] > 60).all() and not sure[200:].any() and (found[200:] <= 1).all()


def test_low_bits_of_majorities():
    draw = np.random.default_rng(9)
    for most in (4, 300, 700):
        sizes = draw.integers(0, most, 50)
        hashes = draw.integers(0, 1 << 64, int(sizes.sum()), dtype=np.uint64)
        assert (bits.low_majorities(hashes, sizes) == bits.majorities(hashes, sizes).astype(np.uint32)).all()
