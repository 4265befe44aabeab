"""Suffix arrays of byte strings in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.zeros(len(raw), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(raw)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def suffix_array(raw: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Positions ordered by the suffixes that start there, as far as their first ``depth`` bytes tell.

    Suffixes are grouped by their first eight bytes; then the order by the first h bytes gives the order by the first
    2h: inside each group that is not yet one suffix, sort by the group of the suffix h bytes on.  Groups of one are
    never touched again.
    """
    n = len(raw)
    words = words_at(raw) if words is None else words
    first = np.ones(n, bool)  # does a group begin here?
    if (raw == 0).any():  # the padding looks like the text's own zeros: the shorter suffix comes first
        left = np.minimum(n - np.arange(n), 8)
        order = np.lexsort((left, words))
        first[1:] = (words[order[1:]] != words[order[:-1]]) | (left[order[1:]] != left[order[:-1]])
    else:
        order = np.argsort(words, kind="stable")
        first[1:] = words[order[1:]] != words[order[:-1]]
    group = np.zeros(n + 1, np.int64)
    group[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) + 1
    group[n] = 0
    open_ = _unsorted(first)
    h = 8
    while h < depth and len(open_):
        at = order[open_]
        key = group[at] * (n + 2) + group[np.minimum(at + h, n)]
        place = np.argsort(key, kind="stable")
        at, key = at[place], key[place]
        order[open_] = at
        fresh = np.empty(len(key), bool)
        fresh[:1] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        first[open_] |= fresh
        group[at] = np.maximum.accumulate(np.where(fresh, open_, 0)) + 1
        open_ = open_[_unsorted(first[open_])]
        h *= 2
    return order


def _unsorted(first: np.ndarray) -> np.ndarray:
    """Places in groups of more than one; ``first`` may leave out places between such groups."""
    alone = first.copy()
    alone[:-1] &= first[1:]
    return np.flatnonzero(~alone)


def common_prefixes(raw: np.ndarray, order: np.ndarray, limit: int, breaks: np.ndarray | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """For each place of ``order`` the common prefix with the suffix before it, exact up to ``limit`` bytes.

    Kasai's rule: if the next suffix of the text is preceded by the predecessor's next one, and the two first bytes
    agreed, the prefix is one byte shorter.
    Only where that chain breaks are bytes compared, eight at a time.  Chains also start anew at ``breaks`` (positions,
    the first of them 0), so that no comparison is longer than ``limit`` and the largest gap between them.
    """
    n = len(raw)
    words = words_at(raw) if words is None else words
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (before[1:] < 0) | (raw[:-1] != raw[before[:-1]])
    if breaks is not None:
        fresh[breaks] = True
    starts = np.flatnonzero(fresh)
    reach = limit + int(np.diff(np.append(breaks, n)).max()) if breaks is not None and len(breaks) else n
    length = np.zeros(len(starts), np.int64)
    live = np.flatnonzero(before[starts] >= 0)
    done = 0
    while len(live) and done < reach:
        a, b = starts[live] + done, before[starts[live]] + done
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        same = np.zeros(len(live), np.int64)
        rest = differ.copy()
        for k in (32, 16, 8):  # whole bytes before the first difference
            zero = rest >> np.uint64(64 - k) == 0
            same += np.where(zero, k // 8, 0)
            rest = np.where(zero, rest << np.uint64(k), rest)
        same = np.where(differ == 0, 8, np.minimum(same, 7))
        end = np.minimum(n - a, n - b)  # padding is not text
        length[live] = done + np.minimum(same, end)
        live = live[(differ == 0) & (end > 8)]
        done += 8
    chain = np.cumsum(fresh) - 1
    plcp = np.maximum(0, length[chain] - (np.arange(n) - starts[chain]))
    return np.minimum(plcp, limit)[order]
