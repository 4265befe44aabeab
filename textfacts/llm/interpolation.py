"""Language-model scores by deleted interpolation of trigram, bigram and unigram estimates.

    P3(w | u v) = k3 * c(u v w) / c(u v) + (1 - k3) * P2(w | v)
    P2(w | v)   = k2 * c(v w) / c(v)     + (1 - k2) * P1(w)
    P1(w)       = k1 * c(w) / N          + (1 - k1) / (V + 1)

``k3`` and ``k2`` depend on how often the context occurs, in buckets by powers of two; a context that never occurs has
weight 0.  The training documents are two halves by the hash of their id.  Each half in turn is deleted from the counts
and the weights are those that make the deleted half likeliest, by expectation-maximisation, level after level from below.
At a level only the ratio of the estimate to the level below matters, so all held-out tokens go into a histogram of that
ratio by bucket (its logarithm in steps of a sixteenth, each step with its mean), which Spark adds up.

Documents are read in shards.  A shard asks once for each different word (by the word itself) and for each different pair
and triple (by a fingerprint long enough that one in a million shares its own) it holds: sorted slices go to ranges, where the counts of all shards meet and are sent
back in the slice's order.  With more than ``FAN`` shards their slices are first put together in groups, so that the
slices stay as many as the shards times ``FAN``.

Defined results: null texts are empty, they have one token, the end; null ids are trained on and not held out; repeated
rows count each; an empty table gives no rows, and without training documents every token is unknown.  Only ``doc_id``
and ``text`` are read.  Words are counted exactly; about one pair or triple in a million shares a fingerprint with
another, and both have the counts of the two together.  A document is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import gathered, is_remainder, table, written_once

DIVISOR, HELD_OUT = 5, 1
SHARD_BYTES = 4 << 20
#: Shards whose slices meet at once; more are put together in groups before.
FAN = 512
BUCKETS = 48
BINS_PER_OCTAVE = 16
STEPS = 500

_START, _END = b" ", b"\n"  # no words
#: Fingerprints are so long that one pair or triple in two to this power shares its own with another.
SPARE_BITS = 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CODEC = "zstd"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, without the end."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


_INSIDE = np.ones(256, bool)
_INSIDE[list(b" \t\n\v\f\r")] = False


def words_of_each(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The ``tokens`` of all texts end to end, cut on the bytes of all at once, and how many each text has."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer((b"\n" + b"\n".join(raw) + b"\n").translate(_LOWER), np.uint8)
    inside = _INSIDE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the first and last bytes part texts and are in no word
    first, sizes = edge[0::2], edge[1::2] - edge[0::2]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    starts = 1 + np.cumsum([0, *(len(t) + 1 for t in raw)])
    return words, np.diff(np.searchsorted(first, starts))


def squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec=_CODEC, asbytes=True)


def numbers_of(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], decompressed_size=8 * n, codec=_CODEC), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").reshape(n)


def joined(words: list[bytes]) -> bytes:
    """Words hold no line ends; the end mark is one, so it is written as nothing."""
    body = b"\n".join([b"" if w == _END else w for w in words])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec=_CODEC, asbytes=True)


def words_of(data: bytes, n: int) -> list[bytes]:
    if not n:
        return []
    size = int.from_bytes(data[:8], "little")
    body = pa.decompress(data[8:], decompressed_size=size, codec=_CODEC, asbytes=True) if size else b""
    return [w or _END for w in body.split(b"\n")]


class Grams:
    """The tokens of some documents: two starts, words and the end of each, end to end.

    ``pairs`` and ``triples`` are the different ones, with ``pair_at`` and ``triple_of`` for every place and token; they
    are found when they are first asked for.
    """

    def __init__(self, sequence: np.ndarray, sizes: np.ndarray, width: int):
        self.sequence, self.sizes, self.width = sequence.astype(np.int32), sizes, width
        first = np.cumsum(sizes) - sizes
        self._inner = np.ones(len(sequence), bool)
        self._inner[first] = False
        later = self._inner.copy()
        later[first + 1] = False
        self.token = np.flatnonzero(later).astype(np.int32)  # places of words and ends
        self.document = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self._inner)
        pairs, which = np.unique(self.sequence[at - 1].astype(np.int64) * self.width + self.sequence[at], return_inverse=True)
        pair_at = np.full(len(self.sequence), -1, np.int32)
        pair_at[at] = which
        return pairs, pair_at

    @cached_property
    def _triples(self) -> tuple[np.ndarray, np.ndarray]:
        key = self.pair_at[self.token - 1].astype(np.int64) * self.width + self.sequence[self.token]
        triples, which = np.unique(key, return_inverse=True)
        return triples, which.astype(np.int32)

    pairs = property(lambda self: self._pairs[0])
    pair_at = property(lambda self: self._pairs[1])
    triples = property(lambda self: self._triples[0])
    triple_of = property(lambda self: self._triples[1])


def _mixed(seed: int, *parts: np.ndarray) -> np.ndarray:
    state = np.full(len(parts[0]), seed, np.uint64)
    for p in parts:
        state = (state ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(31)
        state *= np.uint64(0x94D049BB133111EB)
        state ^= state >> np.uint64(29)
    return state


def fingerprints(grams: Grams, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Of all pairs, then of all triples."""
    pair = grams.pairs // grams.width, grams.pairs % grams.width
    of_pair, last = grams.triples // grams.width, grams.triples % grams.width
    two = _mixed(2, hashes[pair[0]], hashes[pair[1]])
    three = _mixed(3, hashes[pair[0][of_pair]], hashes[pair[1][of_pair]], hashes[last])
    return (np.concatenate([two, three]) >> np.uint64(64 - bits)).astype(np.int64)


_SHARD = pa.schema(
    [("shard", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("fold", pa.list_(pa.int8())), ("sizes", pa.binary()), ("sequence", pa.binary()),
     ("width", pa.int64()), ("words", pa.binary()), ("trained_a", pa.int64()), ("trained_b", pa.int64()), ("n_tokens", pa.int64())]
)
_SHARD_SQL = "shard long, doc_id array<long>, fold array<byte>, sizes binary, sequence binary, width long, words binary, trained_a long, trained_b long, n_tokens long"


def shards(docs: DataFrame) -> DataFrame:
    """A row per shard: its documents (``fold`` -1: not trained on), their tokens as places in ``words``, and the tokens of both halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part in enumerate(gathered(batches, limit=SHARD_BYTES), TaskContext.get().partitionId() << 32):
            words, counts = words_of_each(part.column("text").to_pylist())
            coded = words.dictionary_encode()  # numbered as they first occur
            numbers = [_START, _END, *coded.dictionary.to_pylist()]
            sizes = counts + 3
            last = np.cumsum(sizes) - 1
            sequence = np.full(int(sizes.sum()), -1, np.int32)
            sequence[last - sizes + 1] = sequence[last - sizes + 2] = 0
            sequence[last] = 1
            sequence[sequence < 0] = coded.indices.to_numpy() + 2
            fold = part.column("fold").to_numpy()
            columns = [
                pa.array([shard], pa.int64()),
                pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([fold.tolist()], pa.list_(pa.int8())),
                pa.array([squeezed(sizes)], pa.binary()),
                pa.array([squeezed(sequence)], pa.binary()),
                pa.array([len(numbers)], pa.int64()),
                pa.array([joined(numbers)], pa.binary()),
                *(pa.array([int((sizes[kept] - 2).sum())], pa.int64()) for kept in (fold == 0, fold == 1, fold == fold)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_SHARD)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "fold").mapInArrow(run, _SHARD_SQL)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other, as rows are large."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _opened(row: dict, bits: int) -> tuple[Grams, list[bytes], np.ndarray, np.ndarray]:
    """A shard's tokens, the hashes of its words, and the fingerprints of its pairs and triples."""
    words = words_of(row["words"], row["width"])
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    grams = Grams(numbers_of(row["sequence"]), numbers_of(row["sizes"]), len(words))
    prints = fingerprints(grams, hashes, bits)
    return grams, words, hashes, prints


_SLICE = pa.schema([("place", pa.int64()), ("asker", pa.int64()), *((n, pa.binary()) for n in ("words", "word_a", "word_b", "grams", "gram_a", "gram_b"))])
_SLICE_SQL = "place long, asker long, words binary, word_a binary, word_b binary, grams binary, gram_a binary, gram_b binary"


def _place(high: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    return ((high >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _cut(asker: int, words, hashes, word_counts, prints, gram_counts, ranges: int, bits: int, low: int = 0, high: int | None = None) -> Iterator[tuple]:
    """Slices of sorted words and fingerprints, one for each range from ``low`` to below ``high``."""
    spots = np.arange(low, (ranges if high is None else high) + 1)
    w = np.searchsorted(_place(hashes, 64, ranges), spots)
    g = np.searchsorted(_place(prints.astype(np.uint64), bits, ranges), spots)
    for k, place in enumerate(spots[:-1].tolist()):
        a, b, c, d = w[k], w[k + 1], g[k], g[k + 1]
        yield (place, asker, joined(words[a:b]), *(squeezed(x[a:b]) for x in word_counts),
               squeezed(np.diff(prints[c:d], prepend=0)), *(squeezed(x[c:d]) for x in gram_counts))


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _asked(ranges: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            grams, spelled, hashes, prints = _opened(row, bits)
            fold = np.array(row["fold"], np.int8)
            by_hash, by_print = np.argsort(hashes, kind="stable"), np.argsort(prints, kind="stable")
            word_counts, gram_counts = [], []
            for half in (0, 1):
                kept = (fold == half)[grams.document]
                pair, triple = grams.pair_at[kept], grams.triple_of[kept[grams.token]]
                count = np.bincount(grams.sequence[grams.token[kept[grams.token]]], minlength=grams.width)
                count[0] = int((fold == half).sum())  # a start for each document
                word_counts.append(count[by_hash])
                both = np.concatenate([np.bincount(pair[pair >= 0], minlength=len(grams.pairs)), np.bincount(triple, minlength=len(grams.triples))])
                gram_counts.append(both[by_print])
            words = [spelled[k] for k in by_hash.tolist()]
            yield from _batches(_cut(row["shard"], words, hashes[by_hash], word_counts, prints[by_print], gram_counts, ranges, bits), _SLICE)

    return run


def _read(group: pa.Table) -> tuple[list[int], list[list[bytes]], list, list, list, list, list]:
    out = [group.column("asker").to_pylist(), [], [], [], [], [], []]
    for words, *rest in zip(*(group.column(n).to_pylist() for n in ("words", "word_a", "word_b", "grams", "gram_a", "gram_b")), strict=True):
        a, b, grams, c, d = map(numbers_of, rest)
        for held, value in zip(out[1:], (words_of(words, len(a)), a, b, np.cumsum(grams), c, d), strict=True):
            held.append(value)
    return tuple(out)


def _sums(which: np.ndarray, n: int, parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, which, np.concatenate(parts))
    return out


_TOTALS = pa.schema([("asker", pa.int64()), ("place", pa.int64()), *((n, pa.binary()) for n in ("word_a", "word_b", "gram_a", "gram_b")), ("known", pa.int64())])
_TOTALS_SQL = "asker long, place long, word_a binary, word_b binary, gram_a binary, gram_b binary, known long"


def _met(group: pa.Table) -> tuple:
    """All words and fingerprints of a range's slices, once each, with their sums, and for each slice where its own are."""
    askers, words, word_a, word_b, grams, gram_a, gram_b = _read(group)
    coded = pa.chunked_array([pa.array(w, pa.binary()) for w in words], pa.binary()).combine_chunks().dictionary_encode()
    word_at = coded.indices.to_numpy().astype(np.int64)
    spelled = coded.dictionary.to_pylist()
    distinct, gram_at = np.unique(np.concatenate(grams), return_inverse=True)
    sums = [_sums(word_at, len(spelled), x) for x in (word_a, word_b)] + [_sums(gram_at, len(distinct), x) for x in (gram_a, gram_b)]
    bounds = [np.cumsum([0, *map(len, x)]) for x in (words, grams)]
    return askers, spelled, distinct, sums, (word_at, gram_at), bounds


def _totals_of(askers, place: int, sums, at, bounds, known: int) -> pa.Table:
    rows = []
    for k, asker in enumerate(askers):
        of = [at[i][bounds[i][k] : bounds[i][k + 1]] for i in (0, 0, 1, 1)]
        rows.append((asker, place, *(squeezed(s[o]) for s, o in zip(sums, of, strict=True)), 0 if k else known))
    return pa.Table.from_batches([_batch(rows, _TOTALS)])


def _summed(group: pa.Table) -> pa.Table:
    askers, spelled, _, sums, at, bounds = _met(group)
    known = sum(a > 0 for w, a in zip(spelled, (sums[0] + sums[1]).tolist(), strict=True) if w != _START)
    return _totals_of(askers, group.column("place")[0].as_py(), sums, at, bounds, known)


_NODE = pa.schema([("node", pa.int64()), ("place", pa.int64()), ("askers", pa.list_(pa.int64())), ("words", pa.binary()), *((n, pa.binary()) for n in ("word_a", "word_b", "grams", "gram_a", "gram_b", "word_at", "gram_at", "word_bounds", "gram_bounds"))])
_NODE_SQL = "node long, place long, askers array<long>, words binary, word_a binary, word_b binary, grams binary, gram_a binary, gram_b binary, word_at binary, gram_at binary, word_bounds binary, gram_bounds binary"


def _gathered_node(groups: int):
    """Some askers' slices of a range as one, sorted, and where each asker's own stand in it."""

    def run(group: pa.Table) -> pa.Table:
        askers, spelled, distinct, sums, at, bounds = _met(group)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, spelled), np.uint64, len(spelled))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place, member = group.column("place")[0].as_py(), group.column("member")[0].as_py()
        row = (place * groups + member, place, askers, joined([spelled[k] for k in order.tolist()]), squeezed(sums[0][order]), squeezed(sums[1][order]),
               squeezed(np.diff(distinct, prepend=0)), squeezed(sums[2]), squeezed(sums[3]), squeezed(rank[at[0]]), squeezed(at[1]), *map(squeezed, bounds))
        return pa.Table.from_batches([_batch([row], _NODE)])

    return run


def _node_asked(ranges: int, finer: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            a, b, c, d = (numbers_of(row[n]) for n in ("word_a", "word_b", "gram_a", "gram_b"))
            words = words_of(row["words"], len(a))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            low = row["place"] * finer
            cut = _cut(row["node"], words, hashes, (a, b), np.cumsum(numbers_of(row["grams"])), (c, d), ranges * finer, bits, low, low + finer)
            yield from _batches(cut, _SLICE)

    return run


def _assembled(answers: pa.Table) -> list[np.ndarray]:
    """An asker's sums of words (both halves) and of fingerprints, in its own order."""
    order = np.argsort(answers.column("place").to_numpy(), kind="stable")
    return [np.concatenate([np.zeros(0, np.int64), *(numbers_of(answers.column(n)[int(k)].as_py()) for k in order)]) for n in ("word_a", "word_b", "gram_a", "gram_b")]


def _handed_on(nodes: pa.Table, answers: pa.Table) -> pa.Table:
    if not nodes.num_rows:
        return _TOTALS.empty_table()
    row = nodes.to_pylist()[0]
    at = numbers_of(row["word_at"]), numbers_of(row["gram_at"])
    bounds = numbers_of(row["word_bounds"]), numbers_of(row["gram_bounds"])
    return _totals_of(row["askers"], row["place"], _assembled(answers), at, bounds, sum(answers.column("known").to_pylist()))


def totals(slices: DataFrame, askers: int, ranges: int, bits: int) -> DataFrame:
    """(asker, place, sums in the slice's order, known): the counts of all askers for what each of them holds."""
    if askers <= FAN:
        return slices.groupBy("place").applyInArrow(_summed, _TOTALS_SQL)
    groups = -(-askers // FAN)
    member = F.pmod(F.xxhash64("asker"), F.lit(groups))
    nodes = written_once(slices.withColumn("member", member).groupBy("place", "member").applyInArrow(_gathered_node(groups), _NODE_SQL), "grams-grouped")
    told = totals(nodes.mapInArrow(_node_asked(ranges, groups, bits), _SLICE_SQL), groups, ranges * groups, bits)
    return nodes.groupBy("node").cogroup(told.groupBy("asker")).applyInArrow(_handed_on, _TOTALS_SQL)


_COUNTED = pa.schema([("shard", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("fold", pa.list_(pa.int8())), ("width", pa.int64()), ("trained_a", pa.int64()), ("trained_b", pa.int64()), ("known", pa.int64()), *((n, pa.binary()) for n in ("sizes", "sequence", "word_a", "word_b", "gram_a", "gram_b"))])
_COUNTED_SQL = "shard long, doc_id array<long>, fold array<byte>, width long, trained_a long, trained_b long, known long, sizes binary, sequence binary, word_a binary, word_b binary, gram_a binary, gram_b binary"


def _counted(bits: int):
    """A shard's tokens with the corpus's counts of its words, pairs and triples, in their own order."""

    def run(mine: pa.Table, answers: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return _COUNTED.empty_table()
        row = mine.to_pylist()[0]
        _, _, hashes, prints = _opened(row, bits)
        by_hash, by_print = np.argsort(hashes, kind="stable"), np.argsort(prints, kind="stable")
        known = sum(answers.column("known").to_pylist())
        found = []
        for values, order in zip(_assembled(answers), (by_hash, by_hash, by_print, by_print), strict=True):
            own = np.empty(len(order), np.int64)
            own[order] = values
            found.append(squeezed(own))
        return pa.Table.from_batches([_batch([(row["shard"], row["doc_id"], row["fold"], row["width"], row["trained_a"], row["trained_b"], known, row["sizes"], row["sequence"], *found)], _COUNTED)])

    return run


@dataclass
class Model:
    """``n`` training tokens of each half, ``v`` different ones of both, and the weights by level and bucket."""

    n: tuple[int, int]
    v: int
    weights: tuple[np.ndarray, ...] = ()


def bucket(counts: np.ndarray) -> np.ndarray:
    """0 for a context that never occurs, else by powers of two."""
    return np.minimum(np.frexp(counts.astype(float))[1], BUCKETS - 1)


def _share(part: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    whole = np.broadcast_to(np.asarray(whole, float), part.shape)
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


class Events:
    """All tokens of a shard with the counts that their probabilities need."""

    def __init__(self, row: dict):
        self.doc_id, self.fold = row["doc_id"], np.array(row["fold"], np.int8)
        self.grams = grams = Grams(numbers_of(row["sequence"]), numbers_of(row["sizes"]), row["width"])
        self.word = np.stack([numbers_of(row["word_a"]), numbers_of(row["word_b"])])
        self.document = grams.document[grams.token]
        self._row = row

    @cached_property
    def both(self) -> np.ndarray:
        """Counts of pairs, then of triples."""
        return np.stack([numbers_of(self._row[name]) for name in ("gram_a", "gram_b")])

    def levels(self, halves: tuple[int, ...], chosen: np.ndarray, n: int, upto: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
        """For unigrams, pairs and triples the relative frequency of each chosen token and its context's bucket."""
        grams, at, h = self.grams, self.grams.token[chosen], list(halves)
        word = self.word[h].sum(0)
        out = [(_share(word[grams.sequence[at]], n), np.zeros(len(at), np.int64))]
        if upto > 1:
            pair, before = self.both[h][:, : len(grams.pairs)].sum(0), word[grams.sequence[at - 1]]
            out.append((_share(pair[grams.pair_at[at]], before), bucket(before)))
        if upto > 2:
            triple, context = self.both[h][:, len(grams.pairs) :].sum(0), pair[grams.pair_at[at - 1]]
            out.append((_share(triple[grams.triple_of[chosen]], context), bucket(context)))
        return out


def mixed(levels: list[tuple[np.ndarray, np.ndarray]], model: Model) -> np.ndarray:
    """The probability up to the levels whose weights are known."""
    p = np.full(len(levels[0][0]), 1 / (model.v + 1))
    for (frequency, where), weights in zip(levels, model.weights):
        k = weights[where]
        p = k * frequency + (1 - k) * p
    return p


_CELLS = pa.schema([("cell", pa.int64()), ("tokens", pa.int64()), ("log", pa.float64())])


def _histogram(model: Model):
    """Held-out tokens by bucket and by the ratio of the next level's estimate to the one below."""
    level = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            events = Events(row)
            for half in (0, 1):
                chosen = np.flatnonzero((events.fold == half)[events.document])
                found = events.levels((1 - half,), chosen, model.n[1 - half], level + 1)
                frequency, where = found[level]
                ratio = frequency / mixed(found, model)
                seen = ratio > 0
                log = np.log2(ratio, out=np.zeros(len(ratio)), where=seen)
                step = np.floor(log * BINS_PER_OCTAVE).astype(np.int64)
                low = int(step.min(initial=0))
                span = int(step.max(initial=0)) - low + 2
                at = where * span + np.where(seen, step - low + 1, 0)  # the first step of a bucket is for no ratio
                number = np.bincount(at)
                some = np.flatnonzero(number)
                step = np.where(some % span > 0, some % span - 1 + low, -(1 << 20))
                columns = some // span * (1 << 22) + (step + (1 << 21)), number[some].astype(np.int64), np.bincount(at, log)[some]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CELLS, strict=True)], schema=_CELLS)

    return run


def fitted(where: np.ndarray, tokens: np.ndarray, ratio: np.ndarray, buckets: int = BUCKETS, steps: int = STEPS) -> np.ndarray:
    """By bucket the weight that makes the tokens likeliest, by expectation-maximisation.

    The bucket of contexts that never occur has weight 0 but for the lowest level, which has no context; an empty bucket
    takes the weight of the one before.
    """
    n = np.bincount(where, tokens, buckets)
    k = np.where(n > 0, 0.5, 0.0)
    for _ in range(steps):
        up = k[where] * ratio
        credit = np.bincount(where, tokens * up / (up + 1 - k[where]), buckets)  # the expected share of the estimate
        new = np.divide(credit, n, out=k.copy(), where=n > 0).clip(0, 1 - 1e-9)
        done = np.abs(new - k).max() < 1e-10
        k = new
        if done:
            break
    for b in range(1, buckets):
        if not n[b]:
            k[b] = k[b - 1]
    return k


def learned(counted: DataFrame, n: tuple[int, int], v: int) -> Model:
    """Weights of all three levels; each level's histogram has a few thousand cells, whatever the corpus."""
    model = Model(n, v)
    for level in range(3):
        read = counted if level else counted.drop("gram_a", "gram_b")
        cells = read.mapInArrow(_histogram(model), "cell long, tokens long, log double").groupBy("cell").agg(F.sum("tokens").alias("tokens"), F.sum("log").alias("log"))
        rows = cells.orderBy("cell").collect()
        cell, tokens_of, log = (np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.int64, float, float)))
        step = (cell & ((1 << 22) - 1)) - (1 << 21)
        ratio = np.where(step == -(1 << 20), 0.0, np.exp2(np.divide(log, tokens_of, out=np.zeros(len(rows)), where=tokens_of > 0)))
        weights = fitted(cell >> 22, tokens_of, ratio)
        if level:
            weights[0] = 0.0  # no such context
        model = Model(n, v, (*model.weights, weights))
    return model


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORES_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(model: Model):
    n = sum(model.n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            events = Events(row)
            docs, at = len(events.fold), events.grams.token
            count = events.word.sum(0)[events.grams.sequence[at]]
            score = np.log10(mixed(events.levels((0, 1), np.arange(len(at)), n), model))
            base = np.log10((count + 0.5) / (n + 0.5 * (model.v + 1)))
            columns = [
                events.doc_id,
                events.fold < 0,
                np.bincount(events.document, minlength=docs),
                np.bincount(events.document[count > 0], minlength=docs),
                np.full(docs, n),
                np.bincount(events.document, base, docs),
                np.bincount(events.document, score, docs),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORES, strict=True)], schema=_SCORES)

    return run


def scores(docs: DataFrame, held_out: Column) -> tuple[DataFrame, Model]:
    """Scores of all documents by a model of those that are not ``held_out``; and the model."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    folded = docs.withColumn("fold", F.when(held_out, F.lit(-1)).otherwise(half).cast("byte")).select("doc_id", "text", "fold")
    stored = written_once(shards(folded), "gram-shards")
    askers, n_tokens = stored.select(F.count(F.lit(1)), F.sum("n_tokens")).first()
    ranges = min(FAN, max(1, -(-askers // 2)))
    bits = min(62, max(32, (2 * (n_tokens or 0)).bit_length() + SPARE_BITS))
    told = written_once(totals(stored.mapInArrow(_asked(ranges, bits), _SLICE_SQL), askers, ranges, bits), "gram-totals")
    counted = written_once(stored.groupBy("shard").cogroup(told.groupBy("asker")).applyInArrow(_counted(bits), _COUNTED_SQL), "gram-counts")
    a, b, v = counted.agg(F.sum("trained_a"), F.sum("trained_b"), F.sum("known")).first()
    model = learned(counted, (a or 0, b or 0), v or 0)
    return counted.mapInArrow(_scored(model), _SCORES_SQL), model


def op13_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return scores(table(spark, folder, "documents"), is_remainder(F.col("doc_id"), DIVISOR, HELD_OUT))[0]
