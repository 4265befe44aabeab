"""Weighted acyclic automata: sequences of labels with counts, sharing prefixes and suffixes.

A trie of sequences is a list of levels, each with the parent, the label and the count of its nodes, sorted by parent and
label.  ``Builder`` turns sorted tries, one block after the other, into the smallest automaton with the same counts: a
state that is finished is looked up in a register of states with the same count and the same arcs.  ``union`` walks
several automata at once from their starts and sums counts; ``compose`` walks a trie of wanted sequences and an automaton
together and gives the counts of those the automaton knows.  All walks go level by level over numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_NOTHING = np.zeros(0, np.int64)


class Level(NamedTuple):
    """Nodes of a trie that are equally deep; parents are places in the level above."""

    parent: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    def slice(self, start: int, stop: int, parents: int) -> Level:
        return Level(self.parent[start:stop] - parents, self.label[start:stop], self.weight[start:stop])


@dataclass
class Automaton:
    """State ``s`` has count ``weights[s]`` (0: none) and arcs ``firsts[s]:firsts[s + 1]``; targets come before sources, the start is last.

    Labels are places in ``words``; a state's arcs are in label order.
    """

    words: pa.Array
    weights: np.ndarray
    firsts: np.ndarray
    labels: np.ndarray
    targets: np.ndarray


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the runs ``starts[i] .. starts[i] + sizes[i]``, one run after the other."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class Builder:
    """Builds an automaton from tries that come in the order of their first labels."""

    def __init__(self):
        self._register: dict[tuple, int] = {}
        self._weights: list[np.ndarray] = []
        self._sizes: list[np.ndarray] = []
        self._labels: list[np.ndarray] = []
        self._targets: list[np.ndarray] = []
        self._states = 0
        self._top: list[tuple[np.ndarray, np.ndarray]] = []

    def _states_of(self, weight: np.ndarray, first: np.ndarray, label: np.ndarray, target: np.ndarray) -> np.ndarray:
        """States of finished nodes; those that the register lacks are added."""
        sizes = np.diff(first)
        state = np.empty(len(weight), np.int64)
        added, kept = [], []
        few = np.flatnonzero(sizes <= 1)
        if len(few):  # most nodes: none or one arc, looked up once per distinct kind
            has = sizes[few] == 1
            one_label, one_target = np.full(len(few), -1, np.int64), np.full(len(few), -1, np.int64)
            one_label[has], one_target[has] = label[first[few][has]], target[first[few][has]]
            w = weight[few]
            order = np.lexsort((one_target, one_label, w))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(w[order]) != 0) | (np.diff(one_label[order]) != 0) | (np.diff(one_target[order]) != 0)
            heads = order[new]
            found = np.empty(len(heads), np.int64)
            for k, key in enumerate(zip(w[heads].tolist(), one_label[heads].tolist(), one_target[heads].tolist(), strict=True)):
                known = self._register.get(key)
                if known is None:
                    known = self._register[key] = self._states + len(added)
                    added.append(few[heads[k]])
                found[k] = known
            which = np.empty(len(order), np.int64)
            which[order] = np.cumsum(new) - 1
            state[few] = found[which]
        for node in np.flatnonzero(sizes > 1).tolist():
            a, b = first[node], first[node + 1]
            key = (int(weight[node]), label[a:b].tobytes(), target[a:b].tobytes())
            known = self._register.get(key)
            if known is None:
                known = self._register[key] = self._states + len(added)
                added.append(node)
            state[node] = known
        if added:
            kept = np.array(added)
            arcs = spread(first[kept], sizes[kept])
            self._weights.append(weight[kept])
            self._sizes.append(sizes[kept])
            self._labels.append(label[arcs])
            self._targets.append(target[arcs])
            self._states += len(added)
        return state

    def add(self, levels: Sequence[Level]) -> None:
        """Add a trie; its first labels are larger than those of the tries before."""
        below_label, below_target, below_parent = _NOTHING, _NOTHING, _NOTHING
        for level in reversed(levels):
            first = np.searchsorted(below_parent, np.arange(len(level.label) + 1))
            target = self._states_of(level.weight.astype(np.int64), first, below_label, below_target)
            below_label, below_target, below_parent = level.label.astype(np.int64), target, level.parent
        self._top.append((below_label, below_target))

    def finish(self, words: pa.Array) -> Automaton:
        label = np.concatenate([_NOTHING, *(t[0] for t in self._top)])
        target = np.concatenate([_NOTHING, *(t[1] for t in self._top)])
        sizes = np.concatenate([_NOTHING, *self._sizes, np.array([len(label)])])
        return Automaton(
            words,
            np.concatenate([_NOTHING, *self._weights, np.zeros(1, np.int64)]),
            np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
            np.concatenate([_NOTHING, *self._labels, label]),
            np.concatenate([_NOTHING, *self._targets, target]),
        )


def merged_words(parts: Iterable[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of all parts in byte order, and each part's places in them."""
    parts = list(parts)
    coded = pa.chunked_array([p.cast(pa.binary()) for p in parts], pa.binary()).combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    order = pc.array_sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else _NOTHING
    bounds = np.cumsum([0, *(len(p) for p in parts)])
    return coded.dictionary.take(pa.array(order)), [places[a:b] for a, b in zip(bounds, bounds[1:])]


def union(automata: Sequence[Automaton]) -> tuple[pa.Array, list[Level]]:
    """The trie of all sequences of the automata; counts of equal sequences are added up."""
    words, places = merged_words(a.words for a in automata)
    states = np.cumsum([0, *(len(a.weights) for a in automata)])
    arcs = np.cumsum([0, *(len(a.labels) for a in automata)])
    weights = np.concatenate([a.weights for a in automata])
    firsts = np.concatenate([*(a.firsts[:-1] + n for a, n in zip(automata, arcs)), arcs[-1:]])
    labels = np.concatenate([p[a.labels] for a, p in zip(automata, places)])
    targets = np.concatenate([a.targets + n for a, n in zip(automata, states)])
    at = states[1:] - 1  # the states reached, and the node that stands for each
    node = np.zeros(len(at), np.int64)
    levels = []
    while True:
        sizes = firsts[at + 1] - firsts[at]
        taken = spread(firsts[at], sizes)
        if not len(taken):
            return words, levels
        key = np.repeat(node, sizes) * max(1, len(words)) + labels[taken]
        distinct, node = np.unique(key, return_inverse=True)
        at = targets[taken]
        summed = np.zeros(len(distinct), np.int64)
        np.add.at(summed, node, weights[at])
        levels.append(Level(distinct // len(words), distinct % len(words), summed))


def minimal(words: pa.Array, levels: Sequence[Level]) -> Automaton:
    builder = Builder()
    if levels:
        builder.add(levels)
    return builder.finish(words)


def pruned(levels: Sequence[Level], least: int) -> list[Level]:
    """Without sequences below ``least``; nodes stay that lead to others."""
    kept = []
    alive = None
    for level in reversed(levels):
        keep = level.weight >= least
        if alive is not None:
            keep[alive] = True
        kept.append((level, keep))
        alive = level.parent[keep]
    out, place = [], None
    for level, keep in reversed(kept):
        parent = level.parent[keep] if place is None else place[level.parent[keep]]
        out.append(Level(parent, level.label[keep], np.where(level.weight >= least, level.weight, 0)[keep]))
        place = np.cumsum(keep) - 1
    while out and not len(out[-1].label):
        out.pop()
    return out


def compose(words: pa.Array, wanted: Sequence[Level], known: Automaton) -> list[np.ndarray]:
    """For the nodes of each level of ``wanted`` the counts that ``known`` gives their sequences; 0 without one."""
    place = pc.fill_null(pc.index_in(words.cast(pa.binary()), value_set=known.words.cast(pa.binary())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(known.words))
    arc = np.repeat(np.arange(len(known.weights)), np.diff(known.firsts)) * width + known.labels
    state = np.array([len(known.weights) - 1])
    out = []
    for level in wanted:
        source = state[level.parent]
        label = place[level.label]
        key = source * width + label
        at = np.minimum(np.searchsorted(arc, key), max(0, len(arc) - 1))
        ok = (source >= 0) & (label >= 0)
        if len(arc):
            ok &= arc[at] == key
            state = np.where(ok, known.targets[at], -1)
        else:
            state = np.full(len(label), -1)
        out.append(np.where(state >= 0, known.weights[state], 0))
    return out


def trie(sequences: Sequence[Sequence[int]], weights: Sequence[int]) -> list[Level]:
    """Levels of some sequences of labels."""
    levels, of = [], np.zeros(len(sequences), np.int64)
    left, weight = list(range(len(sequences))), np.asarray(weights, np.int64)
    depth = 0
    while left:
        left = [i for i in left if len(sequences[i]) > depth]
        if not left:
            break
        rows = np.array(left)
        label = np.array([sequences[i][depth] for i in left], np.int64)
        width = int(label.max()) + 1
        distinct, node = np.unique(of[rows] * width + label, return_inverse=True)
        summed = np.zeros(len(distinct), np.int64)
        last = np.array([len(sequences[i]) == depth + 1 for i in left])
        np.add.at(summed, node[last], weight[rows[last]])
        levels.append(Level(distinct // width, distinct % width, summed))
        of[rows] = node
        depth += 1
    return levels


def packed(automaton: Automaton) -> bytes:
    """An automaton as compressed bytes."""
    columns = [automaton.words.cast(pa.binary()), *map(pa.array, (automaton.weights, automaton.firsts, automaton.labels.astype(np.int32), automaton.targets.astype(np.int32)))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(lists, ["words", "weights", "firsts", "labels", "targets"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> Automaton:
    with pa.ipc.open_stream(data) as stream:
        words, *numbers = (c.values for c in stream.read_next_batch().columns)
    return Automaton(words, *(n.to_numpy().astype(np.int64) for n in numbers))
