"""Language identification in two levels: first the family, then one language of it.

A text is its byte trigrams, lower-cased, with anything but letters as a blank,
hashed to ``BUCKETS`` shares.  One linear support vector machine per family picks
the family; inside a family every pair of languages has a machine of its own, and
the language with most votes wins (ties: larger sum of margins, then name).

Defined results: null texts and texts without a letter are ``und`` with score 0.
With no rows to learn from every text is ``und``.  A language with no known family
is a family by itself.  Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import flat_bytes, has_letter, is_remainder, sample_per_class, slices, squared_hinge, table, with_fields

UNKNOWN = "und"
BUCKETS = 2048
#: Bound of the learning sample: so many documents of each language.
SAMPLE_PER_LANGUAGE = 600
#: Language families; a learned language that is not named here is its own family.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic",
}

_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]
    family_weights: np.ndarray  # (BUCKETS + 1, families)
    pairs: list[tuple[int, int, int]]  # family, first and second member
    pair_weights: np.ndarray  # (BUCKETS + 1, pairs)


def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram, where each text's trigrams start, and how many it has."""
    raw, bounds = flat_bytes([b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts])
    raw = _BLANKED[raw].astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    inside = np.ones(len(raw), bool)
    inside[bounds[1:] - 1] = inside[bounds[1:] - 2] = False
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int32)[inside[:-2]]
    counts = np.diff(bounds) - 2
    return bucket, np.concatenate([[0], np.cumsum(counts)]), counts


def _shares(texts: list[str]) -> np.ndarray:
    bucket, starts, counts = _buckets(texts)
    row = np.repeat(np.arange(len(texts)), counts)
    dense = np.bincount(row * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
    return dense / np.maximum(counts, 1)[:, None]


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, limit=1 << 20):
        at, share = [], []
        for text in part.column("text").to_pylist():
            row = _shares([text])[0] if has_letter(text) else np.zeros(BUCKETS)
            at.append(np.flatnonzero(row).astype(np.int32))
            share.append(row[at[-1]].astype(np.float32))
        yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["lang", "at", "share"])


def learn(labelled: DataFrame, families: dict[str, str] = FAMILIES, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Fit on at most ``per_language`` rows (doc_id, text, lang) of each language; None if there are none."""
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    chosen = sample_per_class(rows, "lang", per_language)
    # the sample has a bounded number of narrow rows, so it may be sent to every task
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("text", "lang")
    got = sample.mapInArrow(_sparse_rows, "lang string, at array<int>, share array<float>").toArrow()
    got = got.sort_by([("lang", "ascending")])
    filled = [i for i, at in enumerate(got["at"].to_pylist()) if at]
    if not filled:
        return None
    x = np.zeros((len(filled), BUCKETS), np.float32)
    for k, i in enumerate(filled):
        x[k, got["at"][i].values.to_numpy()] = got["share"][i].values.to_numpy()
    spread = x.std(axis=0) + 1e-4
    centre = x.mean(axis=0)
    x = (x - centre) / spread
    lang = np.array(got["lang"].to_pylist(), object)[filled]

    def machine(rows: np.ndarray, positive: np.ndarray) -> np.ndarray:
        w = squared_hinge(x[rows], np.where(positive, 1, -1).astype(np.float32), decay=0.01)
        scaled = w[:-1] / spread
        return np.append(scaled, w[-1] - scaled @ centre)

    known = sorted(set(lang))
    family_of = {k: families.get(k, k) for k in known}
    names = sorted(set(family_of.values()))
    members = [[k for k in known if family_of[k] == f] for f in names]
    family = np.array([family_of[k] for k in lang], object)
    everything = np.arange(len(x))
    top = [machine(everything, family == f) if len(names) > 1 else np.append(np.zeros(BUCKETS), 1.0) for f in names]
    pairs, weights = [], []
    for f, group in enumerate(members):
        for a, b in combinations(range(len(group)), 2):
            rows_of = np.flatnonzero((lang == group[a]) | (lang == group[b]))
            pairs.append((f, a, b))
            weights.append(machine(rows_of, lang[rows_of] == group[a]))
    pair_weights = np.stack(weights, 1) if weights else np.zeros((BUCKETS + 1, 0))
    return Model(names, members, np.stack(top, 1), pairs, pair_weights)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    languages = [UNKNOWN] * len(texts)
    scores = np.zeros(len(texts))
    good = [i for i, t in enumerate(texts) if has_letter(t)]
    if not good:
        return languages, scores
    bucket, starts, counts = _buckets([texts[i] for i in good])

    def margins(weights: np.ndarray) -> np.ndarray:
        out = np.empty((len(good), weights.shape[1]))
        for k in range(weights.shape[1]):
            out[:, k] = np.add.reduceat(weights[:-1, k].astype(np.float32)[bucket], starts[:-1], dtype=np.float64) / counts + weights[-1, k]
        return out

    top = margins(model.family_weights)
    sure = np.exp(3 * (top - top.max(axis=1, keepdims=True)))
    sure /= sure.sum(axis=1, keepdims=True)
    best = top.argmax(axis=1)
    inner = margins(model.pair_weights)
    for f, group in enumerate(model.members):
        votes = np.zeros((len(good), len(group)))
        sums = np.zeros_like(votes)
        belief = np.zeros_like(votes)
        for k, (of, a, b) in enumerate(model.pairs):
            if of == f:
                m = inner[:, k]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                sums[:, a] += m
                sums[:, b] -= m
                belief[:, a] += _logistic(3 * m)
                belief[:, b] += _logistic(-3 * m)
        order = np.lexsort((np.broadcast_to(-np.arange(len(group)), votes.shape), sums, votes), axis=1)[:, -1]
        for row in np.flatnonzero(best == f):
            pick = order[row]
            inside = belief[row, pick] / (len(group) - 1) if len(group) > 1 else 1.0
            languages[good[row]] = group[pick]
            scores[good[row]] = sure[row, f] * inside
    return languages, scores


def predict(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (doc_id, text, anything else) with language and score added last, under ``names``.

    Columns of those names are replaced; give others to keep them.
    """
    language, score = names
    kept = docs.drop(*names)
    if model is None:
        return kept.withColumns({language: F.lit(UNKNOWN), score: F.lit(0.0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            languages, scores = classify(model, part.column("text").to_pylist())
            columns = [*part.columns, pa.array(languages, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *names])

    return kept.mapInArrow(run, with_fields(kept.schema, **{language: "string", score: "double"}))


def learn_held_out(docs: DataFrame) -> Model | None:
    """A model from the documents whose crc32 of the id is not 0 modulo 5."""
    return learn(docs.where(F.col("doc_id").isNotNull() & ~is_remainder(F.col("doc_id"), 5, 0)))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = _scored_narrow(docs.select("doc_id", "text"), learn_held_out(docs))
    return scored.select("doc_id", is_remainder(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def _scored_narrow(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score): the texts do not come back from the scoring tasks."""
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            languages, scores = classify(model, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
