"""Alignment of two tokenizers' tokens by merge paths.

Both tokenizers see a blank and then the text.  The byte ends of all A tokens and all B tokens of a batch of texts are two
rising lists.  Their merge is cut along diagonals, found by binary search, into pieces of equal work, whatever the texts'
lengths; a piece finds the ends that both lists have inside it, without looking at other pieces.  What lies between such
ends overlaps; groups that cross a piece's border are stitched from the open parts of its neighbours.

Tokenizers cut at a blank between two visible characters whatever stands around it (tested against whole texts), so each
distinct word between such blanks is encoded once per batch of words that a task remembers.

``linked`` tells how firmly the corpus ties each A id to a B id: how many documents hold the pair in one group.  Documents
are kept in shards with their distinct pairs; a shard asks once for each pair it has, so what is shuffled grows with
shards and vocabularies and not with tokens, and a pair that every document has is one row per shard.

Defined results: texts null, empty, or whose joined tokens differ from blank and text have no tokens; repeated rows are
documents of their own and count each; an empty table gives no rows.  Only ``doc_id`` (null stays null) and ``text`` are
read.  Vocabularies are read from files and never trained.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textfacts.llm.automata import spread
from textfacts.llm.common import byte_lengths, gathered, give_back, large_rows, setting, table
from textfacts.session import materialise

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens of both kinds that a piece of a merge path holds.
PIECE_WORK = 1 << 16
#: Text of a batch, and of a shard, which ends sooner if it has so many links.
BATCH_BYTES = 256 << 10
SHARD_BYTES = 4 << 20
SHARD_LINKS = 1 << 20
#: What Spark hands to a task at a time, and what it writes of the shards at a time.
INPUT_BYTES = 4 << 20
WRITTEN_BYTES = 16 << 20
#: Distinct words a task remembers, their characters, and their tokens of both kinds.
REMEMBERED_WORDS = 300_000
REMEMBERED_CHARS = 8 << 20
REMEMBERED_TOKENS = 4 << 20
#: Links that are written out at a time.
LINKS_AT_ONCE = 1 << 20

_MARK = "▁"
_CUT = re.compile(r"(?<=[\w!-~])(?= [\w!-~])")
_OVER = re.compile("[\\w!-~\ufffd] ($|[\\w!-~])")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class Files:
    """The vocabularies' files as read on the driver; as large as the files, whatever the table."""

    a: str
    b: bytes


def read_files(a: str = A_FILE, b: str = B_FILE) -> Files:
    with open(a, encoding="utf-8") as one, open(b, "rb") as two:
        return Files(one.read(), two.read())


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write every byte as one visible letter: itself, or the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def a_spellings(source: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary file."""
    letters = _byte_letters()
    vocabulary = json.loads(source)["model"]["vocab"]
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    return out


def b_spellings(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = _BYTE_PIECE.fullmatch(piece)
        out.append(bytes([int(byte[1], 16)]) if byte else piece.replace(_MARK, " ").encode())
    return out


class Encoder:
    """Ids of both tokenizers; words of earlier batches are remembered up to a bound."""

    def __init__(self, files: Files):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        self.spelled = a_spellings(files.a), b_spellings(self.b)
        self.sizes = tuple(np.array([len(s) for s in spelled], np.int64) for spelled in self.spelled)
        # a piece with a blank behind a visible character could reach over a cut
        self.cuts = not any(_OVER.search(s.decode("utf-8", "replace")) for s in self.spelled[0] + self.spelled[1])
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]  # of all known words, end to end
        self.bounds = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.bad: set[int] = set()
        self.chars = 0

    def words(self, text: str) -> list[str]:
        """A blank and the text, cut into words that are encoded alone."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        for start in range(0, len(new), 8192):
            part = new[start : start + 8192]
            first = len(self.number)
            self.number.update(zip(part, range(first, first + len(part)), strict=True))
            self.chars += sum(map(len, part))
            a = [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)]
            b = self.b.encode([w[1:] for w in part], num_threads=1)  # adds the blank
            data = [w.encode("utf-8", "replace") for w in part]
            size = np.fromiter(map(len, data), np.int64, len(data))
            for k, ids in enumerate((a, b)):
                flat = np.fromiter(chain.from_iterable(ids), np.int32)
                bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
                made = np.concatenate([[0], np.cumsum(self.sizes[k][flat])])[bounds]
                spelled = self.spelled[k]
                if (np.diff(made) != size).any() or b"".join([spelled[i] for i in flat.tolist()]) != b"".join(data):
                    self.bad.update(first + j for j, (x, d) in enumerate(zip(ids, data, strict=True)) if b"".join([spelled[i] for i in x]) != d)
                self.ids[k] = np.concatenate([self.ids[k], flat])
                self.bounds[k] = np.concatenate([self.bounds[k], bounds[1:] + self.bounds[k][-1]])

    def same(self, numbers: list[int], text: str) -> bool:
        """Do the tokens join to the text?  Almost always told by the words alone."""
        if not self.bad or self.bad.isdisjoint(numbers):
            return True
        data = (" " + text).encode("utf-8", "replace")
        return all(
            b"".join([self.spelled[k][i] for n in numbers for i in self.ids[k][self.bounds[k][n] : self.bounds[k][n + 1]].tolist()]) == data
            for k in (0, 1)
        )


@lru_cache(maxsize=1)
def worker_encoder(files: Files) -> Encoder:
    """One for all tasks of a worker: a tokenizer that has encoded keeps some megabytes when it goes."""
    return Encoder(files)


@dataclass
class Tokens:
    """Tokens of some texts end to end: ``ids`` and byte ``ends`` of A and B, and where each text's tokens end."""

    ids: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    bounds: tuple[np.ndarray, np.ndarray]


def tokenize(texts: list[str | None], encoder: Encoder) -> Tokens:
    if len(encoder.number) > REMEMBERED_WORDS or encoder.chars > REMEMBERED_CHARS or sum(map(len, encoder.ids)) > REMEMBERED_TOKENS:
        encoder.forget()
    split = [encoder.words(t) if t else [] for t in texts]
    encoder.learn(w for words in split for w in words)
    numbers = [list(map(encoder.number.__getitem__, words)) for words in split]
    numbers = [n if n and encoder.same(n, t) else [] for n, t in zip(numbers, texts, strict=True)]
    sequence = np.fromiter(chain.from_iterable(numbers), np.int64)
    word_bounds = np.cumsum([0, *map(len, numbers)])
    ids, ends, bounds = [], [], []
    for k in (0, 1):
        counts = np.diff(encoder.bounds[k])[sequence]
        got = encoder.ids[k][spread(encoder.bounds[k][sequence], counts)].astype(np.int64)
        ids.append(got)
        ends.append(np.cumsum(encoder.sizes[k][got]))
        bounds.append(np.concatenate([[0], np.cumsum(counts)])[word_bounds])
    return Tokens(tuple(ids), tuple(ends), tuple(bounds))


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted lists is cut into pieces of ``work`` steps: how much of each lies before.

    Of equal values A's comes first.  All cuts are searched at the same time.
    """
    steps = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (left := low < high).any():
        middle = (low + high) // 2
        on = np.zeros(len(steps), bool)
        on[left] = a[middle[left]] <= b[steps[left] - 1 - middle[left]]
        low, high = np.where(left & on, middle + 1, low), np.where(left & ~on, middle, high)
    return low, steps - low


def piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends that both lists of a piece have, as numbers of tokens up to and with them: overlaps lie between."""
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(at < len(b))
    hit = hit[b[at[hit]] == a[hit]]
    return hit + 1, at[hit] + 1


def groups(a: np.ndarray, b: np.ndarray, work: int = PIECE_WORK) -> tuple[np.ndarray, np.ndarray]:
    """For all groups, how many A and B tokens lie up to their ends."""
    at_a, at_b = diagonals(a, b, work)
    found_a, found_b = [], []
    for k in range(len(at_a) - 1):
        i, j = at_a[k], at_b[k]
        if k and i and j < len(b) and a[i - 1] == b[j]:  # the border parts two equal ends: stitch them
            found_a.append([i])
            found_b.append([j + 1])
        in_a, in_b = piece(a[i : at_a[k + 1]], b[j : at_b[k + 1]])
        found_a.append(in_a + i)
        found_b.append(in_b + j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]).astype(np.int64), np.concatenate([none, *found_b]).astype(np.int64)


@dataclass
class Aligned:
    """Texts' tokens with group ends (tokens up to them) and where each text's groups end."""

    tokens: Tokens
    a_ends: np.ndarray
    b_ends: np.ndarray
    bounds: np.ndarray


def align(texts: list[str | None], encoder: Encoder, work: int = PIECE_WORK) -> Aligned:
    tokens = tokenize(texts, encoder)
    a_ends, b_ends = groups(*tokens.ends, work)
    return Aligned(tokens, a_ends, b_ends, np.searchsorted(a_ends, tokens.bounds[0], side="right") if len(a_ends) else np.zeros(len(texts) + 1, np.int64))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def alignments(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends): tokens, and each group's end as a number of A and of B tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(files or read_files())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for part in gathered(batches, limit=BATCH_BYTES):
            found = align(part.column("text").to_pylist(), encoder)
            group_of = np.repeat(np.arange(part.num_rows), np.diff(found.bounds))
            a_first, b_first = (found.tokens.bounds[k][:-1][group_of] for k in (0, 1))
            columns = [
                part.column("doc_id").combine_chunks().cast(pa.int64()),
                _lists(found.tokens.ids[0], found.tokens.bounds[0]),
                _lists(found.tokens.ids[1], found.tokens.bounds[1]),
                _lists(found.a_ends - a_first, found.bounds),
                _lists(found.b_ends - b_first, found.bounds),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])
        encoder.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, times, len(distinct)).astype(np.int64)


def links(found: Aligned, b_width: int, pair_width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, A id, B id) links in order, as one number each, and how often they occur."""
    a_ids, b_ids = found.tokens.ids
    a_start, b_start = (np.concatenate([[0], e[:-1]]).astype(np.int64) if len(e) else e for e in (found.a_ends, found.b_ends))
    a_size, b_size = found.a_ends - a_start, found.b_ends - b_start
    row = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    upto = np.cumsum(a_size * b_size)
    start = 0
    while start < len(row):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + LINKS_AT_ONCE, side="right")))
        if upto[stop - 1] - before > LINKS_AT_ONCE:  # one long group: its distinct ids, some rows of pairs at a time
            a, a_n = np.unique(a_ids[a_start[start] : found.a_ends[start]], return_counts=True)
            b, b_n = np.unique(b_ids[b_start[start] : found.b_ends[start]], return_counts=True)
            step = max(1, LINKS_AT_ONCE // len(b))
            for k in range(0, len(a), step):
                keys.append((row[start] * pair_width + (a[k : k + step, None] * b_width + b)).ravel())
                times.append((a_n[k : k + step, None] * b_n).ravel())
        else:
            g = np.arange(start, stop)
            sizes = b_size[g]
            a_at = spread(a_start[g], a_size[g])
            group = np.repeat(g, a_size[g])
            each = sizes[group - start]
            b_at = spread(b_start[group], each)
            made = np.repeat(row[group] * pair_width + a_ids[a_at] * b_width, each) + b_ids[b_at]
            part, n = np.unique(made, return_counts=True)
            keys.append(part)
            times.append(n)
        start = stop
    return _counted(np.concatenate(keys), np.concatenate(times))


class Spelling:
    """Digests of groups, written as ``a1,a2|b1;a3|b2``."""

    def __init__(self, ids: int):
        plain = [str(i).encode() for i in range(ids)]
        self.ended = [np.array([p + end for p in plain], object) for end in (b",", b"|", b";")]

    def digests(self, found: Aligned) -> list[str]:
        a_ids, b_ids = found.tokens.ids
        out = np.empty(len(a_ids) + len(b_ids), object)
        a_start, b_start = (np.concatenate([[0], e[:-1]]).astype(np.int64) if len(e) else e for e in (found.a_ends, found.b_ends))
        for ids, ends, start, other, last in ((a_ids, found.a_ends, a_start, b_start, 1), (b_ids, found.b_ends, b_start, found.a_ends, 2)):
            group = np.repeat(np.arange(len(ends)), ends - start)
            place = np.arange(len(ids)) + other[group] if len(ids) else group
            words = self.ended[0][ids]
            words[ends - 1] = self.ended[last][ids[ends - 1]]
            out[place] = words
        bounds = (found.tokens.bounds[0] + found.tokens.bounds[1]).tolist()
        return [hashlib.sha256(b"".join(out[a:b].tolist())[:-1]).hexdigest() if b > a else "" for a, b in zip(bounds, bounds[1:])]


_DOC_LONGS = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
_SHARDS = pa.schema(
    [("shard", pa.int64()), *((n, pa.list_(pa.int64())) for n in _DOC_LONGS), ("groups_sha256", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())),
     ("pair", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32()))]
)
_SHARDS_SQL = (
    "shard long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "ends array<int>, pair array<int>, times array<int>, keys array<long>, holders array<int>"
)


def link_shards(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """A row per shard of documents: their figures, their distinct links as places in the shard's pairs, and its pairs with holders."""
    shared = docs.sparkSession.sparkContext.broadcast(files or read_files())

    def shard_row(number: int, parts: list[dict]) -> pa.RecordBatch:
        figures = [pa.concat_arrays([p[n] for p in parts]) for n in (*_DOC_LONGS, "groups_sha256")]
        sizes = np.concatenate([p["sizes"] for p in parts])
        pairs, holders = np.unique(np.concatenate([p["pairs"] for p in parts]), return_counts=True)
        at = np.concatenate([np.searchsorted(pairs, p.pop("pairs")).astype(np.int32) for p in parts])
        times = pa.concat_arrays([p.pop("times") for p in parts])
        one = [*figures, np.cumsum(sizes), at, times, pairs, holders]
        columns = [pa.array([number], pa.int64())]
        for values, field in zip(one, list(_SHARDS)[1:], strict=True):
            flat = (values if isinstance(values, pa.Array) else pa.array(values)).cast(field.type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        return pa.RecordBatch.from_arrays(columns, schema=_SHARDS)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        widths = [len(s) for s in encoder.spelled]
        pair_width = widths[0] * widths[1]
        pair_type = np.int32 if pair_width <= 1 << 31 else np.int64
        spelling = Spelling(max(widths))
        number, parts, size, held = TaskContext.get().partitionId() << 32, [], 0, 0
        for part in gathered(batches, limit=BATCH_BYTES):
            texts = part.column("text").to_pylist()
            found = align(texts, encoder)
            keys, times = links(found, widths[1], pair_width)
            bounds = found.bounds
            products = np.diff(found.a_ends, prepend=0) * np.diff(found.b_ends, prepend=0)
            upto = np.concatenate([[0], np.cumsum(products)])
            longs = [np.diff(found.tokens.bounds[0]), np.diff(found.tokens.bounds[1]), np.diff(bounds), upto[bounds[1:]] - upto[bounds[:-1]]]
            sizes = np.diff(np.searchsorted(keys, np.arange(part.num_rows + 1) * pair_width))
            row = {n: pa.array(v, pa.int64()) for n, v in zip(_DOC_LONGS[1:], longs, strict=True)}
            row |= {"doc_id": part.column("doc_id").combine_chunks().cast(pa.int64()), "groups_sha256": pa.array(spelling.digests(found), pa.string())}
            parts.append(row | {"sizes": sizes, "pairs": (keys % pair_width).astype(pair_type), "times": pa.array(times).cast(pa.int32())})
            size, held = size + int(byte_lengths(part.column("text")).sum()), held + len(keys)
            if size >= SHARD_BYTES or held >= SHARD_LINKS:
                shard = shard_row(number, parts)
                number, parts, size, held = number + 1, [], 0, 0
                yield shard
                del shard
                give_back()
        if parts:
            yield shard_row(number, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from made(batches)
        worker_encoder(shared.value).forget()  # the worker stays for later tasks
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, _SHARDS_SQL)


def pair_counts(shards: DataFrame, b_width: int) -> DataFrame:
    """(key, n, best): how many documents hold a pair, and whether no other B id does better with its A id."""
    held = shards.select(F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("holders").alias("holder"))))
    counts = held.groupBy("key").agg(F.sum("holder").alias("n"))
    of_a = Window.partitionBy(F.expr(f"key div {b_width}"))  # at most a row per B id
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


_LINKED = pa.schema([*((n, pa.int64()) for n in _DOC_LONGS), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
_LINKED_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _told(shards: pa.Table, answers: pa.Table) -> pa.Table:
    if not shards.num_rows:
        return _LINKED.empty_table()
    get = lambda name: shards.column(name)[0].values
    order = np.argsort(answers.column("key").to_numpy())  # as the shard's pairs are ordered
    n = answers.column("n").to_numpy()[order]
    best = answers.column("best").to_numpy()[order]
    pair, times = get("pair").to_numpy(), get("times").to_numpy().astype(np.int64)
    ends = get("ends").to_numpy()
    sums = []
    for value in (best, n):
        upto = np.concatenate([[0], np.cumsum(times * value[pair])]).astype(np.int64)
        sums.append(pa.array(upto[ends] - upto[np.concatenate([[0], ends[:-1]]).astype(np.int64)]))
    columns = [*(get(name) for name in _DOC_LONGS), *sums, get("groups_sha256")]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, _LINKED, strict=True)], schema=_LINKED)


def linked(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    files = files or read_files()
    b_width = sentencepiece.SentencePieceProcessor(model_proto=files.b).get_piece_size()
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(INPUT_BYTES)):
        shards = materialise(link_shards(docs, files), "link-shards", **large_rows(WRITTEN_BYTES))
    asked = shards.select(F.col("shard").alias("asker"), F.explode("keys").alias("key"))
    answers = asked.join(pair_counts(shards, b_width), "key").select("asker", "key", "n", "best")
    kept = shards.drop("keys", "holders")
    return kept.groupBy("shard").cogroup(answers.groupBy("asker")).applyInArrow(_told, _LINKED_SQL)


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return linked(table(spark, folder, "documents"))
