"""ROUGE-1, ROUGE-2 and ROUGE-L F-measures for token columns.

Each pair is scored where it lies: no shuffle, no join.  The n-gram overlap of
a megabyte of an Arrow batch is counted at once on integer codes; only the
longest common subsequence looks at one pair at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textfacts.functions.batches import by_parts, plain
from textfacts.functions.stemming import rouge_stem
from textfacts.functions.terms import laid_out

METRICS = ("rouge1", "rouge2", "rougeL")
MAX_KNOWN_STEMS = 500_000
LCS_BLOCK = 16_384  # tokens laid out in bits at a time
_SCORES = "struct<rouge1: double, rouge2: double, rougeL: double>"
_SCORE_TYPE = pa.struct([(m, pa.float64()) for m in METRICS])


def _stems(tokens: list[str], known: dict[str, str]) -> list[str]:
    """Stems of distinct tokens; ``known`` keeps them for the task's next batches."""
    if len(known) > MAX_KNOWN_STEMS:
        known.clear()
    for token in tokens:
        if token not in known:
            known[token] = rouge_stem(token)
    return [known[token] for token in tokens]


_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True


def split_batch(lowered: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of a batch of lower-cased texts end to end, and how many each text has.

    The same tokens as :func:`textfacts.functions.text.rouge_tokens`, found on the bytes of the whole batch at once.
    """
    data, starts = laid_out(lowered)
    inside = _TOKEN[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the first and last bytes part texts and are in no token
    first, sizes = edge[0::2], edge[1::2] - edge[0::2]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    counts = np.bincount(np.searchsorted(starts, first, side="right") - 1, minlength=len(starts) - 1)
    return tokens, counts


def _split_once(lowered: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Tokens and counts of each different text, and the number of every row's text; a null counts as empty."""
    encoded = lowered.fill_null("").dictionary_encode()
    return *split_batch(encoded.dictionary), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _codes(left: pa.Array, right: pa.Array, known_stems: dict[str, str] | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Integer codes of both sides' tokens, equal tokens (or stems) sharing a code."""
    encoded = pa.concat_arrays([left.cast(pa.string()), right.cast(pa.string())]).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(encoded.dictionary)
    if known_stems is not None and size:
        stems = _stems(encoded.dictionary.to_pylist(), known_stems)
        stem_codes = pa.array(stems, pa.string()).dictionary_encode()
        codes = stem_codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        size = len(stem_codes.dictionary)
    return codes[: len(left)], codes[len(left):], size


def _lengths(tokens: pa.Array) -> np.ndarray:
    return tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _grams(codes: np.ndarray, rows: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and row numbers of the n-grams that stay inside one row."""
    grams, owner = codes, rows
    for step in range(1, n):
        inside = rows[step:][: len(grams) - 1] == owner[:-1]
        grams = (grams[:-1] * size + codes[step:][: len(grams) - 1])[inside]
        owner = owner[:-1][inside]
    return grams, owner


def _f_measure(overlap: np.ndarray, reference_total: np.ndarray, candidate_total: np.ndarray) -> np.ndarray:
    precision = overlap / np.maximum(candidate_total, 1)
    recall = overlap / np.maximum(reference_total, 1)
    both = precision + recall
    return np.divide(2 * precision * recall, both, out=np.zeros_like(both), where=both > 0)


def _ngram_f(ref, ref_rows, cand, cand_rows, size: int, n: int, height: int) -> np.ndarray:
    ref_grams, ref_owner = _grams(ref, ref_rows, size, n)
    cand_grams, cand_owner = _grams(cand, cand_rows, size, n)
    span = max(size, 1) ** n
    if span * (height + 1) >= 1 << 62:  # dense gram codes keep (row, gram) keys inside 64 bits
        _, dense = np.unique(np.concatenate([ref_grams, cand_grams]), return_inverse=True)
        ref_grams, cand_grams = dense[: len(ref_grams)], dense[len(ref_grams):]
        span = int(dense.max(initial=0)) + 1
    keys, at = np.unique(np.concatenate([ref_owner * span + ref_grams, cand_owner * span + cand_grams]), return_inverse=True)
    in_ref, in_cand = (np.bincount(side, minlength=len(keys)) for side in (at[: len(ref_owner)], at[len(ref_owner):]))
    overlap = np.bincount(keys // span, weights=np.minimum(in_ref, in_cand), minlength=height)
    return _f_measure(
        overlap,
        np.bincount(ref_owner, minlength=height),
        np.bincount(cand_owner, minlength=height),
    )


def lcs_length(a: list[int], b: list[int], block: int = LCS_BLOCK) -> int:
    """Length of the longest common subsequence.

    The longer side is laid out in bits, the shorter one stepped through.  Very
    long texts are laid out block by block: each step's carry goes on to the
    next block, so memory stays bounded and the result is that of the whole.
    """
    if len(a) < len(b):
        a, b = b, a
    wanted = set(b)
    carries = bytes(len(b))
    common = 0
    for start in range(0, len(a), block):
        part = a[start: start + block]
        masks = _bit_rows(part, wanted)
        width = len(part)
        full = (1 << width) - 1
        state = full
        last = start + block >= len(a)
        passed_on = bytearray(len(b))
        for step, token in enumerate(b):
            hit = state & masks.get(token, 0)
            carry = carries[step]
            if hit or carry:
                raised = state + hit + carry
                passed_on[step] = raised >> width
                state = (raised | (state - hit)) & full
        common += width - state.bit_count()
        if not last:
            carries = bytes(passed_on)
    return common


def _bit_rows(tokens: list[int], wanted: set[int]) -> dict[int, int]:
    """For each wanted token, an integer with a bit set at each of its places."""
    places: dict[int, list[int]] = {}
    for i, token in enumerate(tokens):
        if token in wanted:
            places.setdefault(token, []).append(i)
    rows = {}
    for token, spots in places.items():
        row = bytearray((len(tokens) + 7) // 8)
        for i in spots:
            row[i >> 3] |= 1 << (i & 7)
        rows[token] = int.from_bytes(row, "little")
    return rows


def _lcs_f(ref, ref_lengths, cand, cand_lengths) -> np.ndarray:
    ref_ends, cand_ends = np.cumsum(ref_lengths), np.cumsum(cand_lengths)
    ref_list, cand_list = ref.tolist(), cand.tolist()
    common = np.fromiter(
        (
            lcs_length(ref_list[re - rl: re], cand_list[ce - cl: ce])
            for re, rl, ce, cl in zip(
                ref_ends.tolist(), ref_lengths.tolist(), cand_ends.tolist(), cand_lengths.tolist()
            )
        ),
        dtype=np.float64,
        count=len(ref_lengths),
    )
    return _f_measure(common, ref_lengths, cand_lengths)


def score_batch(
    reference: pa.Array,
    candidate: pa.Array,
    metrics: tuple[str, ...] = METRICS,
    known_stems: dict[str, str] | None = None,
) -> pa.Array:
    """Scores of one batch; a null on either side, or a metric left out, gives null.

    Tokens are stemmed if ``known_stems``, which may start empty, is given.
    """
    reference, candidate = plain(reference), plain(candidate)
    codes = _codes(reference.flatten(), candidate.flatten(), known_stems)
    return _scored(codes, _lengths(reference), _lengths(candidate), _missing(reference, candidate), metrics)


def score_texts(
    reference: pa.Array,
    candidate: pa.Array,
    metrics: tuple[str, ...] = METRICS,
    known_stems: dict[str, str] | None = None,
) -> pa.Array:
    """Like :func:`score_batch`, for lower-cased texts that are still to be cut into tokens."""
    reference, candidate = plain(reference), plain(candidate)
    left, left_counts, left_text = _split_once(reference)
    right, right_counts, right_text = _split_once(candidate)
    # texts that stand beside each other several times, as under several models, are scored once
    pair, row = np.unique(left_text * max(len(right_counts), 1) + right_text, return_inverse=True)
    left_text, right_text = pair // max(len(right_counts), 1), pair % max(len(right_counts), 1)
    ref, cand, size = _codes(left, right, known_stems)
    codes = (ref[_places(left_counts, left_text)], cand[_places(right_counts, right_text)], size)
    scores = _scored(codes, left_counts[left_text], right_counts[right_text], np.zeros(len(pair), bool), metrics)
    row = pa.array(row, mask=_missing(reference, candidate))
    return pa.StructArray.from_arrays([scores.field(m).take(row) for m in METRICS], names=list(METRICS))


def _places(counts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where the tokens of the chosen texts lie, one text after the other."""
    lengths = counts[text]
    return np.arange(int(lengths.sum())) + np.repeat((np.cumsum(counts) - counts)[text] - (np.cumsum(lengths) - lengths), lengths)


def _missing(reference: pa.Array, candidate: pa.Array) -> np.ndarray:
    return np.logical_or(reference.is_null().to_numpy(zero_copy_only=False), candidate.is_null().to_numpy(zero_copy_only=False))


def _scored(codes, ref_lengths: np.ndarray, cand_lengths: np.ndarray, missing: np.ndarray, metrics: tuple[str, ...]) -> pa.Array:
    ref, cand, size = codes
    height = len(missing)
    ref_rows = np.repeat(np.arange(height), ref_lengths)
    cand_rows = np.repeat(np.arange(height), cand_lengths)
    columns = []
    for metric in METRICS:
        if metric not in metrics:
            columns.append(pa.nulls(height, pa.float64()))
            continue
        if metric == "rougeL":
            values = _lcs_f(ref, ref_lengths, cand, cand_lengths)
        else:
            values = _ngram_f(ref, ref_rows, cand, cand_rows, size, int(metric[-1]), height)
        columns.append(pa.array(values, pa.float64(), mask=missing))
    return pa.StructArray.from_arrays(columns, names=list(METRICS))


def rouge(
    reference: Column | str,
    candidate: Column | str,
    metrics: tuple[str, ...] = METRICS,
    stemmed: bool = True,
) -> Column:
    """Struct of ROUGE F-measures for two text columns."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    chosen, known_stems = tuple(metrics), {} if stemmed else None

    @F.arrow_udf(_SCORES)
    def scores(ref: pa.Array, cand: pa.Array) -> pa.Array:
        return by_parts(lambda r, c: score_texts(r, c, chosen, known_stems), _SCORE_TYPE, ref, cand)

    return scores(F.lower(reference), F.lower(candidate))
