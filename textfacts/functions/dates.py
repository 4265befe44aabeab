"""Date mentions by a list of patterns, tried only around digits.

Every date holds a digit.  The words with digits are found for a part of an Arrow batch at once; they and their ``reach``
neighbours on both sides are windows, and only windows are searched.  White space of any length parts words, so a window
is wide enough for every pattern in whose mentions each word without a digit stands at most ``reach`` words from one that
has a digit: for "Month day, year" and "day Month year" one word is enough, however much white space lies between.

Windows are cut at ASCII white space only, so other white space keeps more text together and never less.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.functions.batches import by_parts
from textfacts.functions.terms import _PART, laid_out, listed


@dataclass(frozen=True)
class DatePattern:
    """A Python regular expression, searched without regard to case, and the group that is the mention (0: all of it)."""

    regex: str
    group: int = 0


_MONTH = "(" + "|".join(C.MONTHS) + ")[a-z]*"

# Date patterns.
NUMERIC_DATE = DatePattern(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}")
ANY_YEAR = DatePattern(r"\d{4}")
WORD_YEAR = DatePattern(r"\b\d{4}\b")
MONTH_OF_DATE = DatePattern(_MONTH + r"\s+\d{1,2},?\s+\d{4}", group=1)
MONTH_FIRST_DATE = DatePattern(_MONTH + r"\s+\d{1,2},?\s+\d{4}")
DAY_FIRST_DATE = DatePattern(r"\d{1,2}\s+" + _MONTH + r"\s+\d{4}")

_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, _PART]] = True
# other scripts' digits begin at U+0660, so their first byte is 0xD9 or more; such words count as if they had a digit
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_DIGIT[0xD9:_PART] = True
_BETWEEN = 0  # stands between windows


def windows(column: pa.Array, reach: int) -> tuple[str, np.ndarray, np.ndarray]:
    """All windows of a batch as one text, where each begins in it, and its row."""
    data, starts = laid_out(column)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # the text begins and ends in a parting byte
    first, end = edge[0::2], edge[1::2]
    digit = np.flatnonzero(_DIGIT[data])
    none = np.zeros(0, np.int64)
    if not len(digit):
        return "", none, none
    word = np.unique(np.searchsorted(first, digit, side="right") - 1)
    near = np.unique((word[:, None] + np.arange(-reach, reach + 1)).ravel())
    near = near[(near >= 0) & (near < len(first))]
    row = np.searchsorted(starts, first[near], side="right") - 1
    with_digit = np.searchsorted(starts, first[word], side="right") - 1
    # a neighbour counts only beside a word of its own row
    own = np.searchsorted(word, near)
    left, right = np.maximum(own - 1, 0), np.minimum(own, len(word) - 1)
    kept = ((with_digit[left] == row) & (np.abs(word[left] - near) <= reach)) | ((with_digit[right] == row) & (np.abs(word[right] - near) <= reach))
    near, row = near[kept], row[kept]
    cut = np.flatnonzero((np.diff(near) != 1) | (np.diff(row) != 0)) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(near)]]) - 1
    begin, sizes = first[near[a]], end[near[b]] - first[near[a]]
    out = np.full(int(sizes.sum()) + len(sizes), _BETWEEN, np.uint8)
    at = np.cumsum(sizes + 1) - (sizes + 1)
    run = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(at, sizes) + run] = data[np.repeat(begin, sizes) + run]
    characters = np.cumsum((out & 0xC0) != 0x80) - 1
    return out.tobytes().decode("utf-8", "replace"), characters[at], row[a]


def compiled(patterns: Sequence[DatePattern]) -> list[tuple[re.Pattern, int]]:
    return [(re.compile(p.regex, re.IGNORECASE), p.group) for p in patterns]


def dates_of(column: pa.Array, patterns: Sequence[tuple[re.Pattern, int]], reach: int) -> list[tuple[int, str]]:
    """(row, mention) of a batch, once each, by pattern and then by place."""
    joined, begins, rows = windows(column, reach)
    told: dict[tuple[int, str], None] = {}
    for pattern, group in patterns:
        hits = [(m.start(), m[group]) for m in pattern.finditer(joined)]
        if hits:
            of = rows[np.searchsorted(begins, np.array([at for at, _ in hits]), side="right") - 1].tolist()
            told.update(dict.fromkeys(zip(of, (t for _, t in hits), strict=True)))
    return list(told)


def find_dates(text: Column, patterns: Sequence[DatePattern], reach: int = 1) -> Column:
    """Distinct mentions of a text, by pattern and then by place; none for null text."""
    built: list[list[tuple[re.Pattern, int]]] = []

    def of_part(column: pa.Array) -> pa.Array:
        told = dates_of(column, built[0], reach)
        row = np.array([r for r, _ in told], np.int64)
        order = np.argsort(row, kind="stable")
        return listed(row[order], pa.array([t for _, t in told], pa.string()).take(pa.array(order)), len(column))

    @F.arrow_udf("array<string>")
    def found(column: pa.Array) -> pa.Array:
        if not built:
            built.append(compiled(patterns))
        return by_parts(of_part, pa.list_(pa.string()), column)

    return found(text)
