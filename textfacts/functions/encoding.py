"""Token-id arrays: encoding, truncation, padding, masks and labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textfacts import constants as C

# Ids below FIRST_TOKEN_ID are kept for special tokens.
PAD_ID = 1
UNKNOWN_ID = 3
FIRST_TOKEN_ID = 4
MAX_VOCABULARY = 1_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate_ids(ids: Column | str, limit: int) -> Column:
    return F.slice(_col(ids), 1, limit)


def pad_ids(ids: Column | str, length: int, pad_id: int = PAD_ID) -> Column:
    """Cut to ``length`` and fill up to it with ``pad_id``."""
    kept = truncate_ids(ids, length)
    return F.concat(kept, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(kept)))


def attention_mask(ids: Column | str, length: int) -> Column:
    """1 for each kept token, 0 for each pad; from the count, not the pad value."""
    kept = F.least(F.size(_col(ids)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept))


def labels(padded: Column | str, pad_id: int = PAD_ID, mask: bool = True) -> Column:
    """Target ids, with pads replaced so that a loss skips them unless ``mask`` is off."""
    padded = _col(padded)
    if not mask:
        return padded
    ignored = F.lit(C.IGNORED_LABEL)
    return F.transform(padded, lambda t: F.when(t == pad_id, ignored).otherwise(t))


def padded_length(length: Column | str, window: int = C.ATTENTION_WINDOW) -> Column:
    """Length after padding to whole attention windows.

    Up to one window gives one window; beyond that always the next window up,
    also for an exact multiple (1024 gives 1536 for a window of 512).  The
    remainder keeps this in whole numbers, as a column's ``/`` is a double.
    """
    length = _col(length).cast("long")
    return F.when(length <= window, F.lit(window).cast("long")).otherwise(
        length - length % window + window
    )


def encode(tokens: Column | str, vocabulary: Sequence[str]) -> Column:
    """Token ids by position in ``vocabulary``; tokens outside it get ``UNKNOWN_ID``.

    The vocabulary has a fixed top-V size of at most ``MAX_VOCABULARY``, so it
    travels with the function and is built once per task; the look-up is one
    vectorised hash probe per batch and needs no shuffle.
    """
    terms = list(vocabulary)
    if len(terms) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {len(terms)} tokens is too large to send to every task")
    built: list[pa.Array] = []

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not built:
            built.append(pa.array(terms, pa.string()))
        found = pc.index_in(column.flatten().cast(pa.string()), value_set=built[0])
        values = pc.add(found, pa.scalar(FIRST_TOKEN_ID, pa.int32())).fill_null(UNKNOWN_ID)
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        offsets = pa.array(ends, pa.int32(), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, values.cast(pa.int32()))

    return ids(_col(tokens))
