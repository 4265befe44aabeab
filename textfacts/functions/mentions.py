"""Entity mentions: known terms, and a small grammar for names that stand beside titles and place words.

All terms of all types are found by one automaton pass over a part of a batch (:mod:`textfacts.functions.terms`), without regard to
the case of ASCII letters.  What the grammar then looks at are the few words around a title or a place word.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.functions.batches import by_parts
from textfacts.functions.dates import DAY_FIRST_DATE, MONTH_FIRST_DATE, NUMERIC_DATE, WORD_YEAR, DatePattern, compiled, dates_of
from textfacts.functions.terms import Terms, laid_out, whole_words

TYPE = "array<struct<type:string,text:string>>"
_MENTIONS = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())]))
DATES = (NUMERIC_DATE, WORD_YEAR, MONTH_FIRST_DATE, DAY_FIRST_DATE)

# Capitalised words that begin sentences and no names.
NO_NAMES = frozenset(
    ["A", "An", "And", "As", "At", "But", "By", "For", "From", "He", "Her", "His", "In", "It", "Its", "Of", "On", "Or",
     "She", "That", "The", "Their", "These", "They", "This", "Those", "To", "We", "When", "Where", "While", "With"]
)

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[0x41:0x5B] += 0x20
# letters beyond ASCII that fold to ASCII ones: long s, kelvin sign, dotted and dotless i
_FOLDING = re.compile("[ſKİı]")
_FOLDING_BYTES = ("ſ".encode(), "K".encode(), "İ".encode(), "ı".encode())


@dataclass(frozen=True)
class NameGrammar:
    """Titles come before persons' names; place words behind or before the names of places."""

    titles: tuple[str, ...] = tuple(C.VOCABULARY["titles"])
    place_words: tuple[str, ...] = tuple(C.VOCABULARY["admin"])
    person: str = "PERSON"
    place: str = "GPE"


class _Finder:
    """Whole-word terms of several types in a batch, with the places they have in each text's characters."""

    def __init__(self, terms: Mapping[str, Sequence[str]]):
        listed = [(kind, t.lower()) for kind, group in terms.items() for t in dict.fromkeys(group) if t]
        self.kinds = {}
        for kind, term in listed:
            self.kinds.setdefault(term, []).append(kind)
        self.spelled = list(self.kinds)
        self.automaton = Terms(self.spelled)

    def hits(self, texts: list[str | None], data: np.ndarray, starts: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
        """By row (start, end, term) in characters, by start and then the longest first."""
        start, end, term = self.automaton.hits(_UPPER[data])
        free = whole_words(data, start, end)
        start, end, term = start[free], end[free], term[free]
        row = np.searchsorted(starts, start, side="right") - 1
        # places in characters: bytes that begin one, counted from the text's own start
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = first[starts[row]]
        found: dict[int, list[tuple[int, int, str]]] = {}
        for r, a, b, t in zip(row.tolist(), (first[start] - base).tolist(), (first[end] - base).tolist(), term.tolist(), strict=True):
            found.setdefault(r, []).append((a, b, self.spelled[t]))
        body = data.tobytes()
        if any(sign in body for sign in _FOLDING_BYTES):
            for r, text in enumerate(texts):
                if text and _FOLDING.search(text):
                    found[r] = self._folded(text)
        for of_row in found.values():
            of_row.sort(key=lambda h: (h[0], -h[1]))
        return found

    def _folded(self, text: str) -> list[tuple[int, int, str]]:
        """The same for a text with letters that fold to ASCII ones, by a search of every term."""
        out = []
        for term in self.spelled:
            for m in re.finditer(r"(?<!\w)" + re.escape(term) + r"(?!\w)", text, re.IGNORECASE):
                out.append((m.start(), m.end(), term))
        return out


def _first_longest(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The longest hit at the first place, then the next behind it, and so on."""
    out, upto = [], 0
    for hit in hits:
        if hit[0] >= upto:
            out.append(hit)
            upto = hit[1]
    return out


_NEXT_WORD = re.compile(r"[ \t]+([^\W\d_][\w'’-]*)")
_WORD_BEFORE = re.compile(r"(?<![\w'’-])([^\W\d_][\w'’-]*)[ \t]+$")


def _is_name(word: str) -> bool:
    return word[0].isupper() and word not in NO_NAMES


def _name_after(text: str, end: int, taken: set[int]) -> int:
    """Where the capitalised words behind ``end`` end; words of known terms are none."""
    while (m := _NEXT_WORD.match(text, end)) and _is_name(m[1]) and m.start(1) not in taken:
        end = m.end()
    return end


def _name_before(text: str, start: int, floor: int, taken_ends: set[int]) -> int:
    """Where the capitalised words before ``start`` begin, not before ``floor``."""
    while True:
        lowest = max(floor, start - 200)
        m = _WORD_BEFORE.search(text, lowest, start) if lowest < start else None
        if not m or not _is_name(m[1]) or m.end(1) in taken_ends:
            return start
        start = m.start(1)


def _by_grammar(text: str, hits: list[tuple[int, int, str]], roles: Mapping[str, Sequence[str]], grammar: NameGrammar) -> list[tuple[int, str, str]]:
    """(start, type, text) of a text's mentions, from its terms."""
    chosen = _first_longest(hits)
    taken, taken_ends = {a for a, _, _ in chosen}, {b for _, b, _ in chosen}
    out, floor = [], 0
    for a, b, term in chosen:
        if a < floor:
            continue
        kinds = roles[term]
        if _TITLE in kinds:
            end = _name_after(text, b, taken)
            if end > b:
                out.append((a, grammar.person, text[a:end]))
                floor = end
            continue
        if _PLACE in kinds:
            begin, end = _name_before(text, a, floor, taken_ends), b
            if begin == a:
                end = _name_after(text, b, taken)
            if begin < a or end > b:
                out.append((begin, grammar.place, text[begin:end]))
                floor = end
            continue
        out.append((a, kinds[0], text[a:b]))
        floor = b
    return out


_TITLE, _PLACE = "\x00title", "\x00place"


def _answer(rows: list[int], kinds: list[str], texts: list[str], n: int) -> pa.Array:
    order = np.argsort(np.array(rows, np.int64), kind="stable")
    values = pa.StructArray.from_arrays([pa.array(kinds, pa.string()).take(pa.array(order)), pa.array(texts, pa.string()).take(pa.array(order))], ["type", "text"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(np.array(rows, np.int64), minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def find_mentions(
    text: Column,
    gazetteer: Mapping[str, Sequence[str]],
    dates: Sequence[DatePattern] = DATES,
    grammar: NameGrammar | None = None,
) -> Column:
    """``array<struct<type,text>>`` of a text, in its own casing and with repeats; a null text's mentions are null.

    Without a grammar each type's terms are found apart: whole words, the longest of those that begin at a place, by type
    and then by place.  With one, every word belongs to one mention at most, in the order of the text: a title with the
    name behind it is a person, a place word with the name before it, or else behind it, is a place, and titles and place
    words alone are no mentions; terms of the gazetteer are what they are, and names do not reach over them.  Distinct
    dates come last, as type ``DATE``.
    """
    terms = dict(gazetteer)
    if grammar:
        terms |= {_TITLE: grammar.titles, _PLACE: grammar.place_words}
    built: list[tuple[_Finder, list]] = []

    def of_part(column: pa.Array) -> pa.Array:
        finder, patterns = built[0]
        texts = column.to_pylist()
        data, starts = laid_out(column)
        by_row = finder.hits(texts, data, starts)
        told: list[tuple[int, str, str]] = []
        for row in sorted(by_row):
            if grammar:
                told += [(row, kind, t) for _, kind, t in _by_grammar(texts[row], by_row[row], finder.kinds, grammar)]
                continue
            for kind in gazetteer:
                told += [(row, kind, texts[row][a:b]) for a, b, t in _first_longest([h for h in by_row[row] if kind in finder.kinds[h[2]]])]
        told += [(row, "DATE", t) for row, t in dates_of(column, patterns, 1)]
        rows, kinds, values = (list(x) for x in zip(*told)) if told else ([], [], [])
        out = _answer(rows, kinds, values, len(texts))
        if column.null_count:
            offsets = pa.array(out.offsets.to_numpy(), pa.int32(), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False))
            out = pa.ListArray.from_arrays(offsets, out.values)
        return out

    @F.arrow_udf(TYPE)
    def found(column: pa.Array) -> pa.Array:
        if not built:
            built.append((_Finder(terms), compiled(dates)))
        return by_parts(of_part, _MENTIONS, column)

    return found(text)
