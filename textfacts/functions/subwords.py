"""Subword ids by the merges of a byte-pair vocabulary file.

The vocabulary is read from a file of the usual form (``model.vocab`` and ``model.merges`` in JSON) and never trained; any
word can be spelled, as every byte is a token, so there are no unknown words and no cap on the words of a corpus.  Words
are cut as byte-level vocabularies cut them; each different word is merged once and remembered by the task, up to a number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from textfacts.functions.batches import by_parts

# How byte-level vocabularies cut texts into words, and the letters they write bytes with.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VISIBLE_BYTES = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """The letter of every byte: itself where it is visible, else the next free one from 256 on."""
    shown = set(chain.from_iterable(VISIBLE_BYTES))
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Subwords:
    """Ids by word, from the text of a vocabulary file."""

    def __init__(self, source: str):
        model = json.loads(source)["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        letters = byte_letters()
        self.letters = letters
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.spelled = {i: bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode() for piece, i in self.ids.items()}
        self._words = regex.compile(WORD_PATTERN)
        self._known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        """The ids of a word: of all neighbours the pair that was merged first is merged first, until no pair is known."""
        parts = [self.letters[b] for b in word.encode("utf-8", "replace")]
        none = len(self.ranks)
        ranks = [self.ranks.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            merged, at = [], 0
            while at < len(parts):  # all places of the pair, from the left
                if at < len(ranks) and ranks[at] == best:
                    merged.append(parts[at] + parts[at + 1])
                    at += 2
                else:
                    merged.append(parts[at])
                    at += 1
            parts = merged
            ranks = [self.ranks.get(pair, none) for pair in zip(parts, parts[1:])]
        return [self.ids[p] for p in parts]

    def encode(self, text: str) -> Iterator[int]:
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        for word in self._words.findall(text):
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self.word(word)
            yield from ids

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.spelled[i] for i in ids]).decode("utf-8", "replace")


def read_vocabulary(path: str) -> str:
    """The text of a vocabulary file, to give to the functions below; a few megabytes whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _built(source: str):
    made: list[Subwords] = []

    def get() -> Subwords:
        if not made:
            made.append(Subwords(source))
        return made[0]

    return get


def encode_subwords(text: Column | str, vocabulary: str) -> Column:
    """Token ids ``array<int>`` of a text; null for null."""
    get = _built(vocabulary)

    def of_part(column: pa.Array) -> pa.Array:
        subwords = get()
        return pa.array([None if t is None else np.fromiter(subwords.encode(t), np.int32) for t in column.to_pylist()], pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        return by_parts(of_part, pa.list_(pa.int32()), column)

    return ids(F.col(text) if isinstance(text, str) else text)


def decode_subwords(ids: Column | str, vocabulary: str) -> Column:
    """The text that ids spell; null for null."""
    get = _built(vocabulary)

    def of_part(column: pa.Array) -> pa.Array:
        subwords = get()
        return pa.array([None if i is None else subwords.decode(i) for i in column.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return by_parts(of_part, pa.string(), column)

    return text(F.col(ids) if isinstance(ids, str) else ids)
