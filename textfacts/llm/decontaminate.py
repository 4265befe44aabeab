"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with white space runs as one blank.  An item of L characters may be found with
at most k = floor(``error_rate`` x L) edits (insertions, deletions, substitutions).  It is split into k + 1 pieces; k
edits cannot touch them all, so every match holds some piece unchanged.  All pieces of all items are searched in one
pass over the whole text; around each hit the smallest distance is found by Myers' bit-parallel recurrence.

Items are sent to the tasks in blocks of at most about ``BLOCK_CHARS`` characters, one pass over the documents per block,
so a large benchmark never has to fit into one task.

Defined results: null and empty texts match nothing, nor do null items and items without a character; equal items and
repeated documents are reported each; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import slices, table

ERROR_RATE = 0.05
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def split_evenly(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces with their offsets."""
    cuts = np.linspace(0, len(item), budget + 2).astype(int)
    return [(int(a), item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Pattern:
    """One item, ready for Myers' recurrence."""

    def __init__(self, text: str):
        self.length = len(text)
        self.where: dict[str, int] = {}
        for i, c in enumerate(text):
            self.where[c] = self.where.get(c, 0) | (1 << i)

    def distance(self, text: str) -> int:
        """The least edit distance between the item and any part of ``text``."""
        full = (1 << self.length) - 1
        top = 1 << (self.length - 1)
        plus, minus, score = full, 0, self.length
        best = score
        get = self.where.get
        for c in text:
            same = get(c, 0)
            vertical = same | minus
            horizontal = (((same & plus) + plus) ^ plus) | same
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best = score
            up = (up << 1) & full
            down = (down << 1) & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
        return best


class Matcher:
    """All items of a block.  ``items`` has (item_id, normal text) without empty texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE):
        self.items = items
        self.budgets = [int(error_rate * len(text)) for _, text in items]
        self.patterns = [Pattern(text) for _, text in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for offset, piece in split_evenly(text, self.budgets[k]):
                at.setdefault(piece, []).append((k, offset))
        self.search = ahocorasick.Automaton()
        for piece, places in at.items():
            self.search.add_word(piece, (len(piece), places))
        self.search.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, budget) of every item that the text holds."""
        text = normal(text)
        starts: dict[int, list[int]] = {}
        if self.items:
            for end, (size, places) in self.search.iter(text):
                for k, offset in places:
                    starts.setdefault(k, []).append(end - size + 1 - offset)
        found = []
        for k, hits in starts.items():
            item, budget = self.items[k][1], self.budgets[k]
            best = 0 if item in text else self._nearest(text, k, sorted(set(hits)))
            if best <= budget:
                found.append((self.items[k][0], best, budget))
        return found

    def _nearest(self, text: str, k: int, starts: list[int]) -> int:
        """The item can begin at most ``budget`` characters beside where a piece puts it; windows that meet are one."""
        budget, size = self.budgets[k], self.patterns[k].length
        best, a, b = size, None, None
        for start in [*starts, None]:
            if start is not None and a is not None and start - budget <= b:
                b = start + size + budget
                continue
            if a is not None:
                best = min(best, self.patterns[k].distance(text[max(0, a) : b]))
            if start is not None:
                a, b = start - budget, start + size + budget
        return best


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items of ``benchmark`` (item_id, text), dealt by hash to blocks whose size is bounded on average."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // block_chars)
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()
        block = [(r["item_id"], normal(r["text"])) for r in rows]
        yield sorted(((i, t) for i, t in block if t), key=lambda x: (x[0] is None, x[0], x[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, budget) for each document and item it holds."""
    schema = "doc_id long, item_id long, distance int, budget int"

    def one(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, error_rate)
            for part in slices(batches):
                out = [(d, *hit) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for hit in matcher.find(t)]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "distance", "budget"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    parts = [one(items) for items in item_blocks(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the documents that hold an item; texts never leave their tasks."""
    kept = docs
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, error_rate)
            for part in slices(batches):
                yield part.filter(pa.array([not matcher.find(t) for t in part.column("text").to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
