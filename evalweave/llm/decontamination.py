"""Benchmark decontamination by pigeonhole edit matching.

A test item that may differ in ``k`` edits is cut into ``k + 1`` pieces, one of
which must then occur unchanged. Exact hits of pieces are found in one pass over a
text. Each is verified with Myers' bit-parallel distance, from a pair of pieces up
to the whole item: a group of ``p`` pieces may hold ``p - 1`` edits, so most chance
hits end at the first pair.
"""

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm import edit

# Edits allowed, in percent of an item's normalised length.
BUDGET_PERCENT = 10
# Items sent to every task at a time; a larger benchmark is matched in blocks.
ITEM_BYTES = 8 * 1024 * 1024
_BETWEEN = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    """Lower-case letters and digits with single spaces between words and around them."""
    return _BETWEEN.sub(" ", f" {text.lower()} ")


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], budget_percent: int):
        self.ids, self.texts, self.cuts = [], [], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalise(text or "")
            if not text.strip():
                continue
            parts = (len(text) - 2) * budget_percent // 100 + 1
            cuts = [i * len(text) // parts for i in range(parts + 1)]
            for i in range(parts):
                pieces.setdefault(text[cuts[i] : cuts[i + 1]], []).append((len(self.ids), i))
            self.ids.append(item_id)
            self.texts.append(text)
            self.cuts.append(cuts)
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        self.hits = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.hits.add_word(piece, (len(piece), places))
        if pieces:
            self.hits.make_automaton()

    def _groups(self, parts: int, piece: int) -> list[tuple[int, int]]:
        """Groups of pieces around ``piece``, by halving: the smallest first, all pieces last."""
        low, high, out = 0, parts, []
        while high - low > 1:
            out.append((low, high))
            middle = (low + high) // 2
            low, high = (low, middle) if piece < middle else (middle, high)
        return out[::-1]

    def _edits(self, item: int, low: int, high: int, text: str, start: int) -> int:
        """Least edits of pieces ``low`` to ``high`` near the place that a hit gives the item."""
        cuts, budget = self.cuts[item], high - low - 1
        a, b = cuts[low], cuts[high]
        masks = self.masks.get((item, low, high))
        if masks is None:
            masks = self.masks[item, low, high] = edit.letter_masks(self.texts[item][a:b])
        return edit.within(masks, b - a, text[max(0, start + a - budget) : start + b + budget])

    def search(self, text: str) -> dict[int, int]:
        """Least edits by item, for the items found in ``text`` within their budgets."""
        found: dict[int, int] = {}
        if not self.ids:
            return found
        for end, (size, places) in self.hits.iter(text):
            for item, piece in places:
                if found.get(item) == 0:
                    continue
                cuts = self.cuts[item]
                start = end + 1 - size - cuts[piece]
                if start >= 0 and text.startswith(self.texts[item], start):
                    found[item] = 0
                    continue
                edits = 0
                for low, high in self._groups(len(cuts) - 1, piece):
                    edits = self._edits(item, low, high, text, start)
                    if edits > high - low - 1:
                        break
                else:
                    found[item] = min(edits, found.get(item, edits))
        return found


def matches(docs: DataFrame, benchmark: DataFrame, budget_percent: int = BUDGET_PERCENT) -> DataFrame:
    """``(doc_id, item_id, edits)`` for each item of ``benchmark(item_id, text)`` in a document.

    An item is in a document if some part of the normalised text is at most
    ``budget_percent`` of the item's length in edits away from the item; ``edits``
    is the least. Null and empty texts match nothing, items without a letter or
    digit are in no document. Repeated documents and items are each reported,
    null ids too. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    schema = "doc_id long, item_id long, edits long"

    def work_with(block: list[tuple[int, str]]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, budget_percent)
            for batch in batches:
                docs_found, items_found, edits = [], [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for item, least in matcher.search(normalise(text.as_py() or "")).items():
                        docs_found.append(doc_id)
                        items_found.append(matcher.ids[item])
                        edits.append(least)
                columns = [pa.array(c, pa.int64()) for c in (docs_found, items_found, edits)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits"])

        return work

    found = []
    for number in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        block = [tuple(row) for row in mine.collect()]  # about ITEM_BYTES
        texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        found.append(texts.mapInArrow(work_with(block), schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, budget_percent: int = BUDGET_PERCENT) -> DataFrame:
    """``docs`` without the documents that hold an item. Rows without an id are kept."""
    found = matches(docs.filter("doc_id is not null"), benchmark, budget_percent)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
