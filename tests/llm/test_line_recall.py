"""Lines with one or two changes, found by brute-force edit similarity, are near lines."""

import random
import string

import pytest

from evalweave.llm import edit, lines

LETTERS = string.ascii_lowercase


def changed(draw, line, kind):
    """A letter or one or two words replaced, a word deleted or inserted."""
    words, word = line.split(), "".join(draw.choices(LETTERS, k=6))
    at = draw.randrange(len(words))
    if kind == "letter":
        at = draw.randrange(len(line))
        return line[:at] + draw.choice(LETTERS) + line[at + 1 :]
    if kind == "deleted":
        del words[at]
    elif kind == "inserted":
        words.insert(at, word)
    else:
        words[at] = word
        if kind == "two words":
            words[draw.randrange(len(words))] = word[::-1]
    return " ".join(words)


# Least share of the near lines that is found, by the words of the line.
LEAST = {(6, 10): 0.85, (11, 20): 0.9, (21, 80): 0.95}
CHANGES = ("letter", "word", "two words", "deleted", "inserted")


@pytest.fixture(scope="module")
def copies(spark):
    """``(words of the line, change, whether its copy went)`` of near copies, with the limits of the pipeline."""
    draw = random.Random(4)
    vocabulary = ["".join(draw.choices(LETTERS, k=draw.randint(2, 9))) for _ in range(5000)]
    made = []
    for shortest, longest in LEAST:
        for i in range(400):
            line = " ".join(draw.choices(vocabulary, k=draw.randint(shortest, longest)))
            made.append((line, changed(draw, line, CHANGES[i % 5]), (shortest, longest), CHANGES[i % 5]))
    rows = [(2 * i + k, line) for i, (*pair, _, _) in enumerate(made) for k, line in enumerate(pair)]
    found = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {r.row.doc_id for r in found if r.n_removed}
    near = {2 * i + 1 for i, (a, b, *_) in enumerate(made) if edit.alike(lines.normalise(a), lines.normalise(b), 80)}
    assert gone <= near
    return [(length, change, 2 * i + 1 in gone) for i, (*_, length, change) in enumerate(made) if 2 * i + 1 in near]


@pytest.mark.parametrize("length", LEAST)
def test_recall_by_length(copies, length):
    found = [went for n, _, went in copies if n == length]
    assert len(found) > 250 and sum(found) >= LEAST[length] * len(found)


@pytest.mark.parametrize("change", CHANGES)
def test_recall_by_change(copies, change):
    found = [went for _, kind, went in copies if kind == change]
    assert len(found) > 150 and sum(found) >= 0.9 * len(found)
