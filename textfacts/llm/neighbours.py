"""Approximate nearest neighbours by collision counting, for largest inner products.

The index is cut into bands of nearly equal norms (norm-ranging), and these into blocks.  A block's vectors are scaled by
its largest norm and get one more component that makes them unit vectors; a query is
a unit vector without one, so the nearest in Euclidean distance has the largest inner product.  ``PROJECTIONS`` random
directions give every vector one number each; each direction's numbers stand in a sorted array.  For a query, windows
around its own numbers widen step by step in all arrays at once (virtual rehashing), each vector counting the windows it
lies in, until at least ``VERIFIED`` of the vectors (and ``LEAST_VERIFIED`` times as many as asked for) lie in ``COLLISIONS`` of the
windows or more.  All of those, however many, are verified by their exact inner products.

Queries are stated rows and go against all rows, in blocks: an index block of about ``INDEX_BLOCK`` vectors of a band meets a block
of about ``QUERY_BLOCK`` queries in one task, which returns only each query's best; these are merged in two steps.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without an id; of rows with equal ids the smallest vector counts; vectors of another length than the query's are no
candidates of it; ties go to the smaller id; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import table

PROJECTIONS = 64
COLLISIONS = 40
VERIFIED, LEAST_VERIFIED = 0.36, 13
FIRST_WIDTH, GROWTH = 0.7, 1.1
INDEX_BLOCK, QUERY_BLOCK = 8192, 2048
#: Largest norm of a band by its smallest; 1.0 is in the middle of a band.
BAND = 1.25
_MERGED_BLOCKS = 32
_BEST = "query_id long, part int, best array<struct<score: double, vec_id: long>>"
_BEST_ARROW = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("best", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, size) of the rows that take part; ``vector`` has doubles."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select("vec_id", vector.alias("vector")).where("vec_id is not null and vector is not null")
    good = good.where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    return good.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector"))


class CollisionIndex:
    """Sorted projections of one block of vectors (rows of ``vectors``), scaled by the longest of them."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        scaled = vectors / np.abs(vectors).max()
        scaled /= np.sqrt((scaled**2).sum(axis=1).max())
        extra = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
        self.directions = np.random.default_rng(11).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        numbers = scaled @ self.directions[:-1] + extra[:, None] * self.directions[-1]
        self.order = np.ascontiguousarray(np.argsort(numbers, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(numbers.T), self.order, axis=1)

    def candidates(self, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each query (its position comes first) the rows that lie in enough of its windows."""
        n = len(self.vectors)
        target = min(n, max(LEAST_VERIFIED * k, int(VERIFIED * n)))
        own = (queries / np.sqrt((queries**2).sum(axis=1, keepdims=True))) @ self.directions[:-1]
        counts = np.zeros((len(queries), n), np.int16)
        low = np.stack([np.searchsorted(a, own[:, j]) for j, a in enumerate(self.sorted)], axis=1)
        high, width, open_ = low.copy(), FIRST_WIDTH, np.arange(len(queries))
        while len(open_):
            lower = np.stack([np.searchsorted(a, own[open_, j] - width) for j, a in enumerate(self.sorted)], axis=1)
            upper = np.stack([np.searchsorted(a, own[open_, j] + width, side="right") for j, a in enumerate(self.sorted)], axis=1)
            left = []
            for at, i in enumerate(open_):
                bounds = zip(self.order, lower[at].tolist(), low[i].tolist(), high[i].tolist(), upper[at].tolist(), strict=True)
                new = [p for rows, a, b, c, d in bounds for p in (rows[a:b], rows[c:d])]
                counts[i] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                found = np.flatnonzero(counts[i] >= COLLISIONS)
                if len(found) >= target:
                    yield int(i), found
                else:
                    left.append(at)
            low[open_], high[open_] = lower, upper
            open_, width = open_[left], width * GROWTH

    def search(self, queries: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray) -> list[list[dict]]:
        """For each query the ``k`` best of its candidates, best first."""
        out: list = [None] * len(queries)
        for i, rows in self.candidates(queries, k):
            rows = rows[ids[rows] != own[i]]
            scores = self.vectors[rows] @ queries[i]
            if len(rows) > k:  # matrix products round differently than sums in order; a small margin keeps every tie
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                rows = rows[scores >= least - 1e-9 * (1 + abs(least))]
            told = exact(self.vectors[rows], queries[i])
            best = np.lexsort((ids[rows], -told))[:k]
            out[i] = [{"score": s, "vec_id": v} for s, v in zip(told[best].tolist(), ids[rows[best]].tolist(), strict=True)]
        return out


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    return np.cumsum(rows * query, axis=1)[:, -1]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _searched(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return _BEST_ARROW.empty_table()
        ids = index.column("vec_id").to_numpy()
        place = np.argsort(ids)
        block = CollisionIndex(_matrix(index.column("vector"))[place])
        asked = queries.column("vec_id").to_numpy()
        best = block.search(_matrix(queries.column("vector")), k, ids[place], asked)
        part = index.column("index_block")[0].as_py() // _MERGED_BLOCKS
        return pa.Table.from_arrays([pa.array(asked, pa.int64()), pa.array([part] * len(asked), pa.int32()), pa.array(best, _BEST_ARROW.field("best").type)], schema=_BEST_ARROW)

    return run


def _best(rows: Column, k: int) -> Column:
    """The ``k`` best of collected lists: largest score, then smallest id."""
    flat = F.transform(F.flatten(rows), lambda x: F.struct((-x["score"]).alias("minus"), x["vec_id"].alias("vec_id")))
    return F.transform(F.slice(F.array_sort(flat), 1, k), lambda x: F.struct((-x["minus"]).alias("score"), x["vec_id"].alias("vec_id")))


def with_bands(good: DataFrame) -> DataFrame:
    """``good`` with the number of the band that holds each norm; scaled by the largest component, so no square is too large."""
    top = F.array_max(F.transform("vector", F.abs))
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + (x / F.col("top")) * (x / F.col("top")))
    number = F.floor((F.log("top") + F.log(squares) / 2) / log(BAND) + 0.5)
    return good.withColumn("top", top).withColumn("band", number)


def band_blocks(counts: dict[int, int], k: int) -> dict[int, tuple[int, int]]:
    """First block and number of blocks of each band.  Neighbouring bands share a block if all its rows are verified anyway."""
    out, first, held, rows = {}, 0, [], 0
    for band, n in [*sorted(counts.items()), (None, INDEX_BLOCK)]:
        if held and (band is None or rows + n > LEAST_VERIFIED * k):
            blocks = max(1, -(-rows // INDEX_BLOCK))
            out |= dict.fromkeys(held, (first, blocks))
            first, held, rows = first + blocks, [], 0
        held, rows = [*held, band], rows + n
    return out


def nearest(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) where ``queries`` holds its ``k`` nearest."""
    good = usable(vectors)
    asked = good.where(queries)
    banded = with_bands(good)
    dealt = band_blocks({r["band"]: r["count"] for r in banded.groupBy("band").count().collect()}, k)
    q = asked.count()
    index_blocks, query_blocks = max([1, *(first + blocks for first, blocks in dealt.values())]), max(1, -(-q // QUERY_BLOCK))
    # an entry for each band, some thousands at most whatever the norms are
    of_band = lambda values: F.element_at(F.map_from_arrays(F.lit([*dealt]), F.lit(values)), F.col("band"))
    first, blocks = (of_band([at[i] for at in dealt.values()]) if dealt else F.lit(1) for i in (0, 1))
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = banded.select("vec_id", "vector", "size", (first + deal(blocks)).alias("index_block"), every(query_blocks).alias("query_block"))
    right = asked.select("vec_id", "vector", "size", deal(F.lit(query_blocks)).alias("query_block"), every(index_blocks).alias("index_block"))
    keys = ("size", "index_block", "query_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searched(k), _BEST)
    parts = found.groupBy("query_id", "part").agg(_best(F.collect_list("best"), k).alias("best"))
    whole = parts.groupBy("query_id").agg(_best(F.collect_list("best"), k).alias("best"))
    rows = whole.select("query_id", F.posexplode("best").alias("place", "hit"))
    return rows.select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)
