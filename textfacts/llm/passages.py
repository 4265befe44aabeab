"""Removal of repeated passages: every byte of a string of ``SPAN`` bytes that also starts earlier in the corpus.

"Earlier" is a smaller document id, or an earlier start in the same document (null ids come before all others; rows with
equal ids are ordered by where they stand in the input).  Strings are judged on the input and never cross documents.

The order of work, all of it one Spark plan over compressed shards of whole documents:

1. *Segments.*  Each window of ``SPAN`` bytes belongs to the smallest hash among its ``GRAM``-byte strings (the leftmost
   of equals), so equal windows belong to equal grams.  Windows next to each other that belong to one gram form a segment.
2. *Sorted blocks.*  A shard sends one sorted block of segments (gram, digest of the segment's bytes) to each bucket of
   grams; a segment that repeats inside the shard is sent once.  A bucket merges the blocks by binary search.  All but the
   first of equal segments are repeats as a whole.  A gram whose segments are all equal is settled.
3. *Suffix arrays.*  What is left, first segments whose gram stands in other surroundings too, is dealt out by gram with
   its bytes.  Each such shard gets a suffix array (Larsson-Sadakane refinement) and common prefixes (Kasai); neighbours
   with a common prefix of ``SPAN`` bytes are equal windows, of which the first is kept.
4. *Merging.*  A gram with more than ``HOT`` different surroundings is dealt over several shards.  Their first windows meet
   again by digest, in sorted blocks that are merged by binary search.
5. Shards cut what was found out of their texts.

Nothing is dropped and no group is bound to one task: a bucket gets at most one row for a segment from each shard, and
hot grams are split.  Bytes move three times: once compressed as shards, and the bytes of open segments.

Defined results: a null text is empty; texts shorter than ``SPAN`` bytes stay whole; an empty table gives no rows;
repeated rows are documents of their own.  Other columns stay as they are in ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import flat_bytes, gathered, table
from textfacts.llm.suffixes import common_prefixes, suffix_array, words_at

SPAN = 100
GRAM = 36
_GRAMS = SPAN - GRAM + 1  # grams of a window
#: Sizes of the units of work, in bytes of text: a shard, and what feeds a bucket of grams and a shard of open segments.
SHARD_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
OPEN_BYTES = 2 << 20
#: A gram with more surroundings than this is dealt over several shards.
HOT = 4096
_BASE = 0x9E3779B97F4A7C15
_LAST = 1 << 62


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of the ``size`` bytes from each position on, by doubling."""
    power = raw.astype(np.uint64) + np.uint64(1)
    total, covered, step = None, 0, 1
    while True:
        if size & step:
            if total is None:
                total, covered = power, step
            else:
                count = len(raw) - covered - step + 1
                total = total[:count] * np.uint64(pow(_BASE, step, 1 << 64)) + power[covered : covered + count]
                covered += step
        if covered == size:
            break
        power = power[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + power[step:]
        step *= 2
    total = total ^ (total >> np.uint64(31))
    total = total * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def _leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` values, where its smallest is; of equals the leftmost."""
    at = np.arange(len(values), dtype=np.int32)

    def joined(v, i, shift):
        a, b = v[: len(v) - shift], v[shift:]
        later = b < a
        return np.where(later, b, a), np.where(later, i[shift:], i[: len(i) - shift])

    size = 1
    while size * 2 <= width:
        values, at = joined(values, at, size)
        size *= 2
    if size < width:
        values, at = joined(values, at, width - size)
    return at


class Segments:
    """The segments of a shard's texts, in the order of the texts."""

    def __init__(self, texts: list[bytes]):
        self.raw, bounds = flat_bytes(texts)
        self.bounds = bounds
        if len(self.raw) < SPAN:
            self.start = self.stop = self.row = np.zeros(0, np.int64)
            self.key = self.digest = np.zeros(0, np.uint64)
            return
        hashes = gram_hashes(self.raw)
        smallest = _leftmost_smallest(hashes, _GRAMS)  # by window start
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))[: len(smallest)]
        whole = np.arange(len(smallest)) + SPAN <= bounds[row + 1]  # windows inside one text
        fresh = np.ones(len(smallest), bool)
        fresh[1:] = (smallest[1:] != smallest[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(fresh & whole)
        edge = np.flatnonzero(fresh | ~whole)
        ends = np.append(edge, len(smallest))
        self.start, self.stop = start, ends[np.searchsorted(ends, start, side="right")]
        self.row = row[start]
        self.key = hashes[smallest[start]]
        held, digest = self.raw.tobytes(), xxhash.xxh3_64_intdigest
        inner = smallest[start] - start
        found = [digest(held[a:b]) for a, b in zip(self.start.tolist(), (self.stop + SPAN - 1).tolist(), strict=True)]
        # the gram's place is part of what makes two segments equal
        self.digest = np.array(found, np.uint64) + inner.astype(np.uint64) * np.uint64(_BASE) if found else np.zeros(0, np.uint64)

    def bytes_of(self, k: int) -> bytes:
        return self.raw[self.start[k] : self.stop[k] + SPAN - 1].tobytes()


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length each, with their names and types."""
    batch = pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays.values()], [f"{k}:{a.dtype.str}" for k, a in arrays.items()])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(payload).read_next_batch()
    return {n.rsplit(":", 1)[0]: np.frombuffer(c[0].as_py(), n.rsplit(":", 1)[1]) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _from_runs(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the half-open runs, end to end."""
    size = stop - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _to_runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open runs of rising numbers."""
    if not len(numbers):
        return numbers, numbers
    cut = np.flatnonzero(np.diff(numbers) != 1) + 1
    return numbers[np.concatenate([[0], cut])], numbers[np.concatenate([cut - 1, [len(numbers) - 1]])] + 1


def _shards(docs: DataFrame) -> DataFrame:
    """(shard, payload): whole documents in compressed blocks of about ``SHARD_BYTES``, as they stand in the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for number, part in enumerate(gathered(batches, limit=SHARD_BYTES)):
            place = part.column("__place")[0].as_py()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.drop_columns("__place").schema, options=options) as out:
                out.write_table(part.drop_columns("__place").combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([(place << 31) + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["shard", "payload"])

    return docs.withColumn("__place", F.spark_partition_id().cast("long")).mapInArrow(run, "shard long, payload binary")


def _opened(payload: bytes) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """A shard's rows, their ids (null first of all) and their texts."""
    rows = pa.ipc.open_stream(payload).read_all()
    ids = np.array([-_LAST if i is None else i for i in rows.column("doc_id").to_pylist()], np.int64)
    return rows, ids, [(t or "").encode("utf-8", "replace") for t in rows.column("text").to_pylist()]


def _firsts(segments: Segments, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments sorted by (key, digest) without those that repeat in the shard, and the repeats."""
    order = np.lexsort((segments.start, segments.row, ids[segments.row], segments.digest, segments.key))
    key, digest = segments.key[order], segments.digest[order]
    again = np.zeros(len(order), bool)
    again[1:] = (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])
    return order[~again], order[again]


_BLOCK = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("payload", pa.binary())])
_MARKS = pa.schema([("shard", pa.int64()), ("payload", pa.binary())])
_ROUTED = pa.schema([("route", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("payload", pa.binary())])


def _blocks(buckets: int):
    """Step 2, the shard's side."""

    def run(group: pa.Table) -> pa.Table:
        out = []
        for shard, payload in zip(group.column("shard").to_pylist(), group.column("payload"), strict=True):
            _, ids, texts = _opened(payload.as_py())
            segments = Segments(texts)
            first, _ = _firsts(segments, ids)
            bucket = (segments.key[first] % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket):
                k = first[bucket == b]
                out.append((int(b), shard, _pack(key=segments.key[k], digest=segments.digest[k], doc=ids[segments.row[k]], at=k.astype(np.int32))))
        return _rows(out, _BLOCK)

    return run


def _merged(group: pa.Table) -> pa.Table:
    """Step 2, the bucket's side: for each shard its repeats (``salts`` 0) and open segments (over how many shards to deal them)."""
    shard_ids = np.array(group.column("shard").to_pylist(), np.int64)
    blocks = [_unpack(p.as_py()) for p in group.column("payload")]
    sizes = [len(b["key"]) for b in blocks]
    key, digest, doc, at = (np.concatenate([b[c] for b in blocks]) for c in ("key", "digest", "doc", "at"))
    del blocks
    shard = np.repeat(shard_ids, sizes)
    keys = np.unique(key)
    which = np.searchsorted(keys, key)  # binary search of each sorted block in the merged keys
    order = np.lexsort((at, shard, doc, digest, which))
    key_of, digest_of = which[order], digest[order]
    again = np.zeros(len(order), bool)
    again[1:] = (key_of[1:] == key_of[:-1]) & (digest_of[1:] == digest_of[:-1])
    kinds = np.bincount(key_of[~again], minlength=len(keys))
    salts = np.where(again, 0, np.where(kinds[key_of] > 1, -(-kinds[key_of] // HOT), -1))
    told = salts >= 0
    order, salts = order[told], salts[told].astype(np.int32)
    place = np.lexsort((at[order], shard[order]))
    order, salts = order[place], salts[place]
    out = []
    bounds = np.flatnonzero(np.diff(shard[order])) + 1
    for part, salt in zip(np.split(order, bounds), np.split(salts, bounds), strict=True):
        if len(part):
            out.append((int(shard[part[0]]), _pack(at=at[part], salts=salt)))
    return _rows(out, _MARKS)


def _open_segments(groups: int):
    """Step 3, the shard's side: repeats as runs of window starts (kind 0), open segments with their bytes (kind 1)."""

    def run(shards: pa.Table, marks: pa.Table) -> pa.Table:
        out = []
        if not shards.num_rows:
            return _rows(out, _ROUTED)
        shard = shards.column("shard")[0].as_py()
        _, ids, texts = _opened(shards.column("payload")[0].as_py())
        segments = Segments(texts)
        _, again = _firsts(segments, ids)
        got = [_unpack(p.as_py()) for p in marks.column("payload")]
        at = np.concatenate([np.zeros(0, np.int32), *(g["at"] for g in got)])
        salts = np.concatenate([np.zeros(0, np.int32), *(g["salts"] for g in got)])
        repeats = np.sort(np.concatenate([again, at[salts == 0]]))
        if len(repeats):
            out.append((-1 - shard, 0, shard, _pack(start=segments.start[repeats], stop=segments.stop[repeats])))
        left, salts = at[salts > 0], salts[salts > 0]
        key = segments.key[left] % np.uint64(groups)
        salt = np.where(salts > 1, 1 + segments.digest[left] % salts.astype(np.uint64), 0)  # 0: not dealt out
        route = (key.astype(np.int64) << 24) + np.minimum(salt, (1 << 24) - 1).astype(np.int64)
        order = np.lexsort((left, route))
        left, route = left[order], route[order]
        for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(route)) + 1):
            if len(part):
                k = left[part]
                body = b"".join(segments.bytes_of(i) for i in k)
                out.append((int(route[part[0]]), 1, shard, _pack(doc=ids[segments.row[k]], start=segments.start[k], stop=segments.stop[k], body=np.frombuffer(body, np.uint8))))
        return _rows(out, _ROUTED)

    return run


def _passed(group: pa.Table) -> list[tuple]:
    """Rows that are finished."""
    done = group.filter(pa.compute.equal(group.column("kind"), 0))
    return list(zip(*(c.to_pylist() for c in done.columns), strict=True))


def _compared(groups: int):
    """Step 3, suffix arrays over the open segments of some grams."""

    def run(group: pa.Table) -> pa.Table:
        out = _passed(group)
        rest = group.filter(pa.compute.equal(group.column("kind"), 1))
        if not rest.num_rows:
            return _rows(out, _ROUTED)
        got = [_unpack(p.as_py()) for p in rest.column("payload")]
        shard_ids = np.array(rest.column("shard").to_pylist(), np.int64)
        shard = np.repeat(shard_ids, [len(g["doc"]) for g in got])
        doc, start, stop = (np.concatenate([g[c] for g in got]) for c in ("doc", "start", "stop"))
        body = np.concatenate([g["body"] for g in got])
        del got
        size = stop - start + SPAN - 1
        source = np.cumsum(size) - size
        order = np.lexsort((start, shard, doc))  # earlier in the corpus is earlier in the text that is sorted
        body = body[_from_runs(source[order], source[order] + size[order])]
        shard, doc, start, size = shard[order], doc[order], start[order], size[order]
        where = np.cumsum(size) - size
        windows = _from_runs(where, where + size - SPAN + 1)
        valid = np.zeros(len(body), bool)
        valid[windows] = True
        words = words_at(body)
        suffixes = suffix_array(body, SPAN, words)
        shared = common_prefixes(body, suffixes, SPAN, where, words)
        kind = np.cumsum(shared < SPAN)
        keep = valid[suffixes]
        at, kind = suffixes[keep], kind[keep]
        order = np.lexsort((at, kind))
        at, kind = at[order], kind[order]
        first = np.ones(len(at), bool)
        first[1:] = kind[1:] != kind[:-1]
        repeats = np.sort(at[~first])
        out += _window_runs(repeats, where, shard, start)
        if rest.column("route")[0].as_py() % (1 << 24):  # a hot gram: the first windows meet those of the other shards
            at = np.sort(at[first])
            owner = np.searchsorted(where, at, side="right") - 1
            held = body.tobytes()
            mark = np.array([xxhash.xxh3_128_digest(held[i : i + SPAN]) for i in at.tolist()], "S16") if len(at) else np.zeros(0, "S16")
            mark = np.frombuffer(mark.tobytes(), "<u8").reshape(-1, 2)
            bucket = (mark[:, 0] % np.uint64(groups)).astype(np.int64)
            for b in np.unique(bucket):
                k = np.flatnonzero(bucket == b)
                k = k[np.lexsort((mark[k, 1], mark[k, 0]))]
                of = owner[k]
                out.append((int(b), 2, -1, _pack(low=mark[k, 0].copy(), high=mark[k, 1].copy(), doc=doc[of], shard=shard[of], start=start[of] + at[k] - where[of])))
        return _rows(out, _ROUTED)

    return run


def _window_runs(windows: np.ndarray, where: np.ndarray, shard: np.ndarray, start: np.ndarray) -> list[tuple]:
    """Rows for the shards: runs of window starts, from places in a text of segments."""
    if not len(windows):
        return []
    owner = np.searchsorted(where, windows, side="right") - 1
    return _by_shard(shard[owner], start[owner] + windows - where[owner])


def _by_shard(shard: np.ndarray, start: np.ndarray) -> list[tuple]:
    order = np.lexsort((start, shard))
    shard, start = shard[order], start[order]
    out = []
    for part in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
        a, b = _to_runs(np.unique(start[part]))
        owner = int(shard[part[0]])
        out.append((-1 - owner, 0, owner, _pack(start=a, stop=b)))
    return out


def _met(group: pa.Table) -> pa.Table:
    """Step 4: first windows of hot grams, merged by digest."""
    out = _passed(group)
    rest = group.filter(pa.compute.equal(group.column("kind"), 2))
    if rest.num_rows:
        got = [_unpack(p.as_py()) for p in rest.column("payload")]
        low, high, doc, shard, start = (np.concatenate([g[c] for g in got]) for c in ("low", "high", "doc", "shard", "start"))
        lows = np.unique(low)
        order = np.lexsort((start, shard, doc, high, np.searchsorted(lows, low)))
        again = np.zeros(len(order), bool)
        again[1:] = (low[order[1:]] == low[order[:-1]]) & (high[order[1:]] == high[order[:-1]])
        found = order[again]
        if len(found):
            out += _by_shard(shard[found], start[found])
    return _rows([(s, p) for _, _, s, p in out], _MARKS)


def _finished(render, schema: pa.Schema):
    """Step 5: ``render`` makes rows from a shard's rows, texts, and the bytes to be removed of each."""

    def run(shards: pa.Table, found: pa.Table) -> pa.Table:
        if not shards.num_rows:
            return schema.empty_table()
        rows, _, texts = _opened(shards.column("payload")[0].as_py())
        raw, bounds = flat_bytes(texts)
        change = np.zeros(len(raw) + 1, np.int64)
        for payload in found.column("payload"):
            runs = _unpack(payload.as_py())
            np.add.at(change, runs["start"], 1)
            np.add.at(change, runs["stop"] + SPAN - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        return render(rows, raw, bounds, gone)

    return run


def _summary(rows: pa.Table, raw: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> pa.Table:
    out = []
    for doc_id, a, b in zip(rows.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
        cut = gone[a:b]
        spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if b > a else 0
        out.append((doc_id, int(b - a), int(cut.sum()), spans, hashlib.sha256(raw[a:b][~cut].tobytes()).hexdigest()))
    return _rows(out, _SUMMARY)


_SUMMARY = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _cut(rows: pa.Table, raw: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> pa.Table:
    """The same rows with what is left of the texts; texts that lose nothing stay as they are, nulls too."""
    texts = rows.column("text").to_pylist()
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        cut = gone[a:b]
        if cut.any():
            texts[k] = raw[a:b][~cut].tobytes().decode("utf-8", "ignore")  # a cut can split a character
    at = rows.schema.get_field_index("text")
    return rows.set_column(at, "text", pa.array(texts, pa.string()))


def _applied(docs: DataFrame, render, schema: str | None) -> DataFrame:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = lambda size: max(1, -(-total // size))
    by_shard = _shards(docs).groupBy("shard")
    blocks = by_shard.applyInArrow(_blocks(units(BUCKET_BYTES)), "bucket long, shard long, payload binary")
    marks = blocks.groupBy("bucket").applyInArrow(_merged, "shard long, payload binary")
    routed = "route long, kind int, shard long, payload binary"
    opened = by_shard.cogroup(marks.groupBy("shard")).applyInArrow(_open_segments(units(OPEN_BYTES)), routed)
    compared = opened.groupBy("route").applyInArrow(_compared(units(OPEN_BYTES)), routed)
    found = compared.groupBy("route").applyInArrow(_met, "shard long, payload binary")
    kind = docs.schema if schema is None else schema
    arrow = _SUMMARY if schema else pa.schema([])
    return by_shard.cogroup(found.groupBy("shard")).applyInArrow(_finished(render, arrow), kind)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    return _applied(docs.select("doc_id", "text"), _summary, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, anything else) with what is left of each text; no row is dropped."""
    return _applied(docs, _cut, None)


def op10_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeats(table(spark, folder, "documents"))
