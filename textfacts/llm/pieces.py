"""SentencePiece encoding and decoding by Viterbi search that shares prefixes.

A text is a blank and then itself; it is cut before each run of blanks into marked words, which no piece of a vocabulary
crosses.  The distinct words of a batch are sorted, which is a depth-first walk of their trie: the best scores and last
pieces of a prefix stay on a stack, and the next word goes on from the prefix it shares with the one before.

The best segmentation has the largest sum of piece scores; among equal sums every position keeps its longest last piece.
A character that no piece spells is its UTF-8 bytes (the vocabulary's byte pieces), as is the mark sign itself, so
decoding gives every text back.  Vocabularies are read from files and never trained.

Defined results: null texts encode to null, empty ones to no ids; repeated rows are encoded each; an empty table gives
no rows.  Extra columns stay; one named ``ids`` is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from textfacts.llm.common import gathered, table, with_fields

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words of earlier batches that a task remembers.
REMEMBERED = 150_000
_BATCH_BYTES = 2 << 20
_WORD = re.compile(" +[^ ]*|[^ ]+")
_UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """``ids`` by piece (blanks for marks), ``scores`` by piece, ids of bytes, and the bytes of every id."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_ids: list[int]
    spelled: list[bytes]

    def __post_init__(self):
        floor = min(self.scores.values(), default=0.0)
        self.unknown = floor - _UNKNOWN_PENALTY
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            lengths.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {end: sorted(sizes, reverse=True) for end, sizes in lengths.items()}


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, bytes_ids, spelled = {}, {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:-1], 16)
            bytes_ids[value] = i
            spelled.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            piece = piece.replace(MARK, " ")
            ids[piece], scores[piece] = i, model.get_score(i)
            spelled.append(piece.encode())
    return Vocabulary(ids, scores, bytes_ids, spelled)


def segment(words: Iterable[str], vocabulary: Vocabulary) -> dict[str, tuple[int, ...]]:
    """Ids of each distinct word."""
    scores, ids, lengths, unknown = vocabulary.scores, vocabulary.ids, vocabulary.lengths, vocabulary.unknown
    single: dict[str, tuple[int, ...]] = {}
    out = {}
    best, last = [0.0], [0]  # by position: the best score of the prefix and the length of its last piece
    before = ""
    for word in sorted(words):
        shared = len(commonprefix((before, word)))
        del best[shared + 1 :], last[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, size = best[end - 1] + unknown, 1
            sure = False
            tail = word[end - 2 : end] if end > 1 else word[:1]
            for n in lengths.get(tail, ()):
                if n <= end and (score := scores.get(word[end - n : end])) is not None:
                    score += best[end - n]
                    if score > top or not sure and score == top:
                        top, size, sure = score, n, True
            if len(tail) == 2 and (score := scores.get(tail[1])) is not None and (score := score + best[end - 1]) > top:
                top, size = score, 1
            best.append(top)
            last.append(size)
        found, end = [], len(word)
        while end:
            piece = word[end - last[end] : end]
            i = ids.get(piece)
            if i is None:  # one character that has no piece
                if piece not in single:
                    single[piece] = tuple(vocabulary.bytes_ids[b] for b in reversed(piece.encode("utf-8", "replace")))
                found.extend(single[piece])
            else:
                found.append(i)
            end -= last[end]
        out[word] = tuple(reversed(found))
        before = word
    return out


class Encoder:
    """Encodes batches; words of earlier batches are remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        words = [_WORD.findall(" " + t) if t else [] for t in texts]
        wanted = set(chain.from_iterable(words))
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {w: self.known[w] for w in wanted if w in self.known}
        self.known.update(segment(new, self.vocabulary))
        get = self.known.__getitem__
        return [None if t is None else list(chain.from_iterable(map(get, w))) for t, w in zip(texts, words, strict=True)]


def decode(ids: Iterable[int] | None, vocabulary: Vocabulary) -> str | None:
    if ids is None:
        return None
    spelled = vocabulary.spelled
    return b"".join([spelled[i] for i in ids])[1:].decode("utf-8", "replace")


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` (text and anything else) with ``ids`` added last."""
    kept = docs.drop("ids")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file, whatever the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in gathered(batches, limit=_BATCH_BYTES):
            ids = pa.array(encoder.encode(part.column("text").to_pylist()), pa.list_(pa.int32()))
            yield from part.append_column("ids", ids).to_batches(max_chunksize=part.num_rows)

    return kept.mapInArrow(run, with_fields(kept.schema, ids="array<int>"))


def decoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` (ids and anything else) with ``decoded`` added last."""
    kept = rows.drop("decoded")
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = pa.array([decode(x, shared.value) for x in part.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return kept.mapInArrow(run, with_fields(kept.schema, decoded="string"))


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip): the ids are digested as 32-bit little-endian numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in gathered(batches, limit=_BATCH_BYTES):
            texts = part.column("text").to_pylist()
            counts, sums, same = [], [], []
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                counts.append(None if ids is None else len(ids))
                sums.append(None if ids is None else hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
                same.append(decode(ids, shared.value) == text)
            doc_ids = part.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"), load_vocabulary())
