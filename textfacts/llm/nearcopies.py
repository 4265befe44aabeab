"""Near copies: documents whose sets of word shingles have a Jaccard similarity of ``THRESHOLD`` or more.

1. A document is the set of hashes of its runs of five words (a shorter one has a single run).  Documents with equal sets
   are one text; everything below is between different texts.
2. MinHash values in bands send similar texts to common keys.  A pair at the threshold shares no key with probability
   (1 - 0.8^5)^36, under one in a million.
3. Texts that share keys form candidate components (connected with star edges, never with all pairs of a key).  A
   component is compared as a whole; a large one in pairs of blocks, so that no task holds more than two blocks.
4. Inside a task pairs are compared by Bayesian pruning: MinHash values come in steps, and a pair goes as soon as the
   posterior probability of reaching the threshold, P(J >= t | m of n values agree) = P(Bin(n + 1, t) <= m) under a flat
   prior, falls below ``TOLERANCE``.  What is left is verified exactly on the shingle sets.
5. Tasks give back how many links each text has and a spanning forest of the links, never the pairs.  The forests'
   components are the classes.

Texts are told apart by 64-bit digests of their sets, shingles by 64-bit hashes.

Defined results: null texts and texts without words are alone in their class, without links; a class is named by its
smallest document id (nulls count only if there is no other); repeated rows are copies of each other; an empty table
gives no rows.  Other columns are ignored, or kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import slices, table, with_fields
from textfacts.llm.components import connected
from textfacts.session import materialise

THRESHOLD = 0.8
WORDS = 5
BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
#: A pair is dropped when its posterior probability of being a link is smaller.
TOLERANCE = 1e-6
STEP = 15
#: Texts that a task compares with each other at a time.
BLOCK = 1000
#: Texts of small components that travel together.
BUNDLE = 2000
REMEMBERED_WORDS = 200_000
#: Bytes of text whose shingles a task holds at a time.
SLICE_BYTES = 2 << 20

_draw = np.random.default_rng(20)
_TIMES = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = _draw.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _draw.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], known: dict[str, int]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [t.split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    out = []
    total = np.zeros(max(0, len(flat) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        total += flat[k : k + len(total)] * _PLACE[k]
    total = _mixed(total)
    for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(total[end - n : end - WORDS + 1]))
        elif n:
            few = flat[end - n : end]
            out.append(_mixed((few * _PLACE[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash values (32 bits each) of sets that are not empty."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])]) if sets else np.zeros(0, np.int64)
    out = np.empty((len(sets), HASHES), np.uint32)
    if sets:
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(flat * _TIMES[k] + _PLUS[k], starts) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    parts = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return _mixed((parts * _BAND).sum(axis=2) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _key(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for part in slices(batches, limit=SLICE_BYTES):
        sets = shingle_sets(part.column("text").to_pylist(), known)
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        for i, row in zip(full, band_keys(signatures([sets[i] for i in full])).view(np.int64), strict=True):
            bands[i] = row
        keys = pa.array([_key(s) if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), keys, pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])


def _least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n compared values the smallest number of agreeing ones with which a pair stays."""
    out = []
    for n in range(HASHES + 1):
        total, m = 0.0, -1
        while m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return out


def links_of(sets: list[np.ndarray], other: list[np.ndarray] | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all linked pairs: inside ``sets`` (i < j), or between ``sets`` and ``other``."""
    everything = sets if other is None else sets + other
    sizes = np.array([len(s) for s in everything])
    marks = signatures(everything)
    left = np.arange(len(sets))
    right = left if other is None else np.arange(len(sets), len(everything))
    ratio = np.minimum(sizes[left][:, None], sizes[right]) >= threshold * np.maximum(sizes[left][:, None], sizes[right]) - 1e-9
    if other is None:
        ratio &= left[:, None] < right
    i, j = np.nonzero(ratio)
    j = right[j]
    needed = _least_matches(threshold, tolerance)
    agree = np.zeros(len(i), np.int32)
    for start in range(0, HASHES, STEP):
        for a in range(0, len(i), 1 << 17):  # bounded copies
            b = slice(a, a + (1 << 17))
            agree[b] += (marks[i[b], start : start + STEP] == marks[j[b], start : start + STEP]).sum(axis=1, dtype=np.int32)
        stay = agree >= needed[start + STEP]
        i, j, agree = i[stay], j[stay], agree[stay]
    if len(i):
        stay = _common(everything, i, j)
        stay = stay >= threshold * (sizes[i] + sizes[j] - stay) - 1e-9
        i, j = i[stay], j[stay]
    return i, j


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections, by bit sets over the shingles that stand in more than one set."""
    used = np.unique(np.concatenate([i, j]))
    flat = np.concatenate([sets[k] for k in used])
    names, times = np.unique(flat, return_counts=True)
    names = names[times > 1]
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    width = -(-len(names) // 64) or 1
    total = np.zeros(len(i), np.int64)
    for start in range(0, width, 1024):  # a slice of the vocabulary at a time
        part = names[start * 64 : (start + 1024) * 64]
        wide = -(-len(part) // 64) or 1
        bits = np.zeros((len(used), wide), np.uint64)
        for row, k in enumerate(used):
            at = np.searchsorted(part, sets[k])
            at = at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == sets[k])] if len(part) else at[:0]
            np.bitwise_or.at(bits[row], at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        step = max(1, (1 << 21) // wide)
        for a in range(0, len(i), step):
            both = bits[place[i[a : a + step]]] & bits[place[j[a : a + step]]]
            total[a : a + step] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return total


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all the links connect."""
    root = list(range(n))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with their sets; a row whose text is not the one that was asked for goes."""
    known = _WordHashes()
    for part in slices(batches, limit=SLICE_BYTES):
        sets = shingle_sets(part.column("text").to_pylist(), known)
        right = pa.array([len(s) > 0 and _key(s) == k for s, k in zip(sets, part.column("key").to_pylist(), strict=True)], pa.bool_())
        rest = part.drop_columns("text")
        columns = [*rest.columns, pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, "shingles"]).filter(right)


_FOUND = "kind int, a long, b long"


def _compare(group: pa.Table) -> pa.Table:
    """Rows (0, text, its links) and (1, text, text) of a spanning forest, for the components of one route."""
    rows: dict[int, dict[int, tuple[int, bytes]]] = {}
    for component, key, side, shingles in zip(*(group.column(c).to_pylist() for c in ("component", "key", "side", "shingles")), strict=True):
        rows.setdefault(component, {})[key] = (side, shingles)
    kind, a, b = [], [], []
    for members in rows.values():
        keys = sorted(members, key=lambda k: (members[k][0], k))
        sets = [np.frombuffer(members[k][1], np.uint64) for k in keys]
        cut = sum(members[k][0] == 0 for k in keys)
        i, j = links_of(sets, None) if cut in (0, len(sets)) and _whole(group) else links_of(sets[:cut], sets[cut:])
        for k, n in enumerate(np.bincount(np.concatenate([i, j]), minlength=len(sets)).tolist()):
            if n:
                kind.append(0), a.append(keys[k]), b.append(n)
        for x, y in _forest(len(sets), i, j):
            kind.append(1), a.append(keys[x]), b.append(keys[y])
    return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _whole(group: pa.Table) -> bool:
    """Is the route one for comparisons inside a block (or inside components), not between two blocks?"""
    return bool(group.column("inside")[0].as_py())


def _routes(candidates: DataFrame) -> DataFrame:
    """``candidates`` (component, key, ...) with route, inside and side, a row for every pair of blocks it stands in."""
    sizes = candidates.groupBy("component").agg(F.count("*").alias("size"))
    bundles = sizes.agg(F.sum("size")).first()[0] or 0
    bundles = max(1, bundles // BUNDLE)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    small = F.col("blocks") == 1
    spread = candidates.join(sizes, "component").withColumn("blocks", blocks).withColumn("block", mine)
    spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    route = F.when(small, F.pmod(F.xxhash64("component"), F.lit(bundles))).otherwise(F.xxhash64("component", low, high))
    return spread.select(
        "component",
        "key",
        "doc_id",
        F.concat_ws(":", small.cast("int"), route).alias("route"),
        (small | (low == high)).alias("inside"),
        F.when(F.col("block") == low, 0).otherwise(1).alias("side"),
    )


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, key, class_id, class_key, n_links, n_copies) of each document of ``docs`` (doc_id, text).

    ``n_links`` counts the different texts that the document is linked to, ``n_copies`` the documents with its own text;
    ``class_id`` is the smallest document id of its class and ``class_key`` the text of that document.
    """
    narrow = docs.select("doc_id", "text")
    sketch = materialise(narrow.mapInArrow(_sketches, "doc_id long, key long, bands array<long>"), "sketches")
    banded = sketch.where("key is not null").select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("band", "least")
    stars = banded.join(shared, "band").where("key > least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    components = materialise(connected(stars).select(F.col("node").alias("key"), "component"), "components")

    texts = sketch.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))
    wanted = _routes(components.join(texts.select("key", "doc_id"), "key"))
    ones = wanted.select("key", "doc_id").distinct()
    sides = ones.select(F.col("doc_id").alias("wanted_id"), "key").join(narrow, F.col("wanted_id").eqNullSafe(F.col("doc_id"))).select("key", "text")
    shingles = sides.mapInArrow(_shingled, "key long, shingles binary")
    found = wanted.drop("doc_id").join(shingles, "key").groupBy("route").applyInArrow(_compare, _FOUND)
    found = materialise(found, "links")

    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n_links")).select(F.col("a").alias("key"), "n_links")
    classes = connected(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    grouped = texts.join(classes.select(F.col("node").alias("key"), "component"), "key", "left").join(counts, "key", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "key"))
    # nulls last: a null id names a class only if it has no other
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    names = grouped.groupBy("component").agg(first.alias("first")).select("component", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("class_key"))
    told = grouped.join(names, "component").select("key", "class_id", "class_key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    rest = sketch.select("doc_id", "key").join(told, "key", "left")
    alone = F.col("key").isNull()
    return rest.select(
        "doc_id",
        "key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "class_key",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, anything else) with one document of each class; texts without words all stay."""
    kept = near_copies(docs).where("class_key is not null").select(F.col("class_id").alias("__id"), F.col("class_key").alias("__key")).distinct()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for part in slices(batches, limit=SLICE_BYTES):
            keys = [_key(s) if len(s) else None for s in shingle_sets(part.column("text").to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], [*part.schema.names, "__own"])

    own = docs.mapInArrow(keyed, with_fields(docs.schema, __own="long"))
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
    chosen = own.where("__own is not null").join(kept, match, "left_semi").dropDuplicates(["doc_id", "__own"])
    return chosen.unionByName(own.where("__own is null")).drop("__own")


def op1_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "n_copies")
