"""Finding any of many terms in texts, in one pass.

The terms are one automaton over bytes: a state for every prefix of a term, and from each state a step for each byte to the
longest prefix that ends there.  The texts of a part of an Arrow batch lie end to end and are cut into some thousand lanes, which
take their steps together; a lane starts early by the longest term's length, so nothing is lost between lanes.  A step
costs the same however many terms there are.  Terms inside longer terms and terms that overlap are all found.

The terms travel with the function and the automaton is built once per task; its table has (letters of all terms) times
(different bytes in them) entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textfacts.functions.batches import by_parts

#: About how many lanes a batch is cut into, and the fewest bytes of a lane.
LANES = 8192
LANE_BYTES = 256


class Terms:
    """The automaton of distinct terms; empty ones are never found."""

    def __init__(self, terms: Sequence[str]):
        spelled = [t.encode() for t in terms]
        self.sizes = np.array([len(t) for t in spelled], np.int64)
        self.longest = int(self.sizes.max(initial=0))
        letters = sorted(set(b"".join(spelled)))
        self.classes = np.zeros(256, np.int32)  # class 0: bytes of no term
        self.classes[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1

        children: list[dict[int, int]] = [{}]
        depth, ends = [0], {}
        for i, word in enumerate(spelled):
            node = 0
            for byte in word:
                below = children[node].get(byte)
                if below is None:
                    below = children[node][byte] = len(children)
                    children.append({})
                    depth.append(depth[node] + 1)
                node = below
            if word:
                ends.setdefault(node, []).append(i)
        source, byte, target = (np.array(x, np.int64) for x in zip(*((n, b, c) for n, d in enumerate(children) for b, c in d.items()))) if len(children) > 1 else (np.zeros(0, np.int64),) * 3
        step = np.zeros((len(children), self.width), np.int32)
        fallback = np.zeros(len(children), np.int32)
        level = np.array(depth)[source]
        outputs: dict[int, list[int]] = {}
        for d in range(self.longest):  # states as deep as d are complete, from the shallowest on
            here = np.flatnonzero(level == d)
            nodes = np.flatnonzero(np.array(depth) == d)
            if d:
                step[nodes] = step[fallback[nodes]]
            s, c, t = source[here], self.classes[byte[here]], target[here]
            fallback[t] = step[fallback[s], c] if d else 0
            step[s, c] = t
        last = np.flatnonzero(np.array(depth) == self.longest)
        if self.longest:
            step[last] = step[fallback[last]]
        for node in np.argsort(depth, kind="stable").tolist():  # what ends in a state, longest first
            told = ends.get(node, []) + (outputs.get(int(fallback[node]), []) if node else [])
            if told:
                outputs[node] = told
        # states in which terms end get the largest numbers
        ending = np.zeros(len(children), bool)
        ending[list(outputs)] = True
        order = np.argsort(ending, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        self.first_ending = int((~ending).sum())
        self.step = np.ascontiguousarray(number[step[order]] * self.width).ravel()
        told = [outputs[n] for n in order[self.first_ending :].tolist()]
        self.told_bounds = np.cumsum([0, *map(len, told)])
        self.told = np.array([i for t in told for i in t], np.int64)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where terms begin and end in ``data`` and which they are, by place and then by length.

        Texts must be parted by a byte that no term holds.
        """
        nothing = np.zeros(0, np.int64)
        if not self.longest or not len(data):
            return nothing, nothing, nothing
        early = self.longest - 1
        size = max(LANE_BYTES, -(-len(data) // LANES))
        lanes = -(-len(data) // size)
        padded = np.full(early + lanes * size, _PART, np.uint8)
        padded[early : early + len(data)] = data
        shifted = np.lib.stride_tricks.as_strided(padded, (early + size, lanes), (1, size))
        first = self.first_ending * self.width
        state = np.full(lanes, 0, np.int32)
        base = np.arange(lanes, dtype=np.int64) * size - early
        ends, states = [nothing], [nothing]
        for at in range(early + size):
            state = self.step.take(state + self.classes.take(shifted[at]))
            if at >= early and (hit := np.flatnonzero(state >= first)).size:
                ends.append(base[hit] + at + 1)
                states.append(state[hit] // self.width - self.first_ending)
        end, told = np.concatenate(ends), np.concatenate(states)
        counts = np.diff(self.told_bounds)[told]
        place = np.arange(int(counts.sum())) + np.repeat(self.told_bounds[told] - (np.cumsum(counts) - counts), counts)
        term, end = self.told[place], np.repeat(end, counts)
        start = end - self.sizes[term]
        order = np.lexsort((end, start))
        return start[order], end[order], term[order]


_PART = 0xFF  # no byte of UTF-8 text
_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"]] = True


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, each behind a parting byte, and where each text begins (one more entry for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    sizes = np.diff(offsets)
    if column.null_count:
        sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    starts = np.cumsum(sizes + 1) - sizes
    data = np.full(int(sizes.sum()) + len(sizes) + 1, _PART, np.uint8)
    body = column.buffers()[2]
    if body is not None and sizes.sum():
        source = np.frombuffer(body, np.uint8)
        if sizes.sum() == offsets[-1] - offsets[0]:  # no bytes under nulls
            keep = np.ones(len(data), bool)
            keep[starts - 1] = keep[-1] = False
            data[keep] = source[offsets[0] : offsets[-1]]
        else:
            for a, n, o in zip(starts.tolist(), sizes.tolist(), offsets.tolist()):
                data[a : a + n] = source[o : o + n]
    return data, np.append(starts, len(data))


def _letter_before(data: np.ndarray, at: int) -> bool:
    first = at - 1
    while data[first] & 0xC0 == 0x80:
        first -= 1
    return bytes(data[first:at]).decode("utf-8", "replace").isalnum()


def _letter_at(data: np.ndarray, at: int) -> bool:
    size = 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
    return bytes(data[at : at + size]).decode("utf-8", "replace").isalnum()


def whole_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which hits have no letter, digit or underscore right before or behind them."""
    before, behind = data[start - 1], data[end]
    free = ~(_ASCII_WORD[before] | _ASCII_WORD[behind])
    for k in np.flatnonzero(free & (((before >= 0x80) & (before != _PART)) | ((behind >= 0x80) & (behind != _PART)))).tolist():
        a, b = int(start[k]), int(end[k])
        if 0x80 <= data[a - 1] < _PART and _letter_before(data, a) or 0x80 <= data[b] < _PART and _letter_at(data, b):
            free[k] = False
    return free


def listed(row: np.ndarray, values: pa.Array, rows: int) -> pa.Array:
    """Values by row (in rising order) as one list per row."""
    ends = np.cumsum(np.bincount(row, minlength=rows))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def find_terms(lowered: Column, terms: Iterable[str], word: bool = False) -> Column:
    """Distinct terms of a text, in the order of ``terms``; no terms for null."""
    wanted = list(dict.fromkeys(terms))
    built: list[Terms] = []

    def of_part(column: pa.Array) -> pa.Array:
        data, starts = laid_out(column)
        start, end, term = built[0].hits(data)
        if word and len(start):
            free = whole_words(data, start, end)
            start, term = start[free], term[free]
        row = np.searchsorted(starts, start, side="right") - 1
        once = np.unique(row * len(wanted) + term)
        spelled = pa.array(wanted, pa.string()).take(pa.array(once % max(1, len(wanted))))
        return listed(once // max(1, len(wanted)), spelled, len(column))

    @F.arrow_udf("array<string>")
    def found(column: pa.Array) -> pa.Array:
        if not built:
            built.append(Terms(wanted))
        return by_parts(of_part, pa.list_(pa.string()), column)

    return found(lowered)
