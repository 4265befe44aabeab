"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textfacts.session import materialise

SLICE_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``materialise``, and the shuffle files of the job go when it ends: later jobs read the table."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return materialise(df, name)
    finally:
        conf.set(_CLEANUP, before)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Holds while the job inside runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def large_rows(limit: int) -> dict[str, str]:
    """Options to ``materialise`` rows of megabytes: a row group ends at ``limit`` bytes, also below 100 rows."""
    return {"parquet.block.size": str(limit), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def give_back() -> None:
    """What this Python process has freed goes back to the system, where that can be asked for."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def with_fields(schema: T.StructType, **kinds: str) -> T.StructType:
    """A new schema with fields added last."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in kinds.items())).fields])


def crc_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key's text, modulo ``divisor``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def is_remainder(key: Column, divisor: int, wanted: int) -> Column:
    return F.coalesce(crc_remainder(key, divisor) == wanted, F.lit(False))


def sample_per_class(rows: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` (doc_id, label) rows of each label, in the order of the hashed key."""
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    return (
        rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .select("doc_id", label)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
        .select("doc_id", label)
        .distinct()
    )


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def byte_lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs whose texts have about ``limit`` bytes; one long text is a run of its own."""
    for batch in batches:
        ends = np.cumsum(byte_lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Like ``slices``, but small batches are put together until they have about ``limit`` bytes."""
    held, size = [], 0
    for piece in slices(batches, column, limit):
        held.append(piece)
        size += int(byte_lengths(piece.column(column)).sum())
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def flat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end, and where each text starts (one more entry for the end)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def squared_hinge(x: np.ndarray, y: np.ndarray, decay: float, steps: int = 150) -> np.ndarray:
    """Weights (last: intercept) of a linear support vector machine; ``y`` is +1 or -1, classes weigh the same.

    Accelerated gradient descent on mean squared hinge loss plus ``decay`` times the squared weights.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):  # largest curvature, by the power method
        v = x.T @ (share * (x @ v))
        top = np.linalg.norm(v) + 1e-12
        v /= top
    rate = 1 / (2 * (top + decay))
    free = np.ones(x.shape[1], x.dtype)  # what decays: all but the intercept
    free[-1] = 0
    w = np.zeros(x.shape[1], x.dtype)
    ahead = w.copy()
    for k in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        slope = 2 * (decay * free * ahead - x.T @ (share * y * slack))
        new = ahead - rate * slope
        ahead = new + (k - 1) / (k + 2) * (new - w)
        w = new
    return w.astype(np.float64)
