"""Arrow batches taken in parts of bounded size.

An Arrow batch has a number of rows, whatever their length, and what is computed over a whole batch takes many times its
bytes.  Row-by-row functions therefore go through a batch by neighbouring rows of at most some bytes together, so their
memory depends on neither the rows of a batch nor those of a task; a longer row is a part of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the texts looked at together.
PART_BYTES = 1 << 20


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each row's text, or of its list of numbers; nulls have none."""
    listed = pa.types.is_list(column.type)
    sizes = pc.list_value_length(column) if listed else pc.binary_length(column)
    width = column.type.value_type.bit_width // 8 if listed else 1
    return pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64) * width


def parts(*columns: pa.Array, limit: int | None = None) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of a batch by neighbouring rows of at most ``limit`` bytes together, in order."""
    ends = np.cumsum(sum(_sizes(c) for c in columns))
    start, done = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, done + (limit or PART_BYTES), side="right")))
        yield tuple(c.slice(start, stop - start) for c in columns)
        start, done = stop, int(ends[stop - 1])


def by_parts(made: Callable[..., pa.Array], kind: pa.DataType, *columns: pa.Array | pa.ChunkedArray) -> pa.Array:
    """What ``made`` gives for the columns of a batch, a part at a time."""
    found = [made(*part) for part in parts(*map(plain, columns))]
    return pa.concat_arrays(found) if found else pa.array([], kind)
