"""Document quality by Bradley-Terry ranking.

Every preference pair puts a good document above a bad one.  A document's strength
is linear in measurements of its text; the weights minimise the logistic loss of
strength differences over the pairs.  The threshold is a quantile of the strengths
of the learning sample (the share of bad documents in it), and the score is the
logistic of strength minus threshold, so 0.5 is the threshold.

Defined results: null and empty texts are measured as texts without words and get a
score like any other.  With labels of one kind only (or none) every score is 0.5.
Columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import is_remainder, sample_per_class, slices, table

#: Bound of the learning sample: so many documents of each label.
SAMPLE_PER_LABEL = 4000
#: Preference pairs drawn from the sample.
PAIRS = 60_000

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_REPEAT = re.compile(r"(.)\1\1")
NAMES = [f"share of {c}" for c in _MARKS] + [
    "letters", "upper case", "digits", "blanks", "line ends", "other bytes", "marks", "runs of three",
    "word length", "spread of word length", "distinct words", "short words", "long words", "words in capitals",
    "words ending in a mark", "distinct lines", "words per line", "log words", "few words", "commonest word", "title words",
]


def measure(text: str | None) -> np.ndarray:
    """The numbers that a score may depend on, from the whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    marks = seen[[ord(c) for c in _MARKS]] / n
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    words = text.split()
    lines = text.split("\n")
    count = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = Counter(words)
    top = max(distinct.values(), default=0) / count
    capitals = sum(map(str.isupper, words)) / count
    ends = sum(not w[-1].isalnum() for w in words) / count
    rest = [
        (upper + lower) / n, upper / max(1, upper + lower), digits / n, (seen[32] + seen[9]) / n, seen[10] / n, seen[128:].sum() / n, marks.sum(),
        len(_REPEAT.findall(text)) / n,
        lengths.mean() / 10, lengths.std() / 10, len(distinct) / count, (lengths <= 3).mean(), (lengths >= 12).mean(), capitals,
        ends, len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)), np.log1p(len(words)) / 8, float(len(words) < 20), top,
        sum(map(str.istitle, words)) / count,
    ]
    return np.concatenate([np.sqrt(marks), rest])


@dataclass
class Ranking:
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    threshold: float
    scale: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.threshold) * self.scale, -30, 30)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, decay: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-w.(better - worse))) plus ``decay`` times w squared."""
    gap = better - worse
    rate = 1 / (0.25 * np.linalg.eigvalsh(gap.T @ gap / len(gap))[-1] + 2 * decay)
    w = np.zeros(gap.shape[1])
    ahead = w.copy()
    for k in range(1, steps + 1):
        lost = 1 / (1 + np.exp(np.clip(gap @ ahead, -30, 30)))
        new = ahead + rate * (gap.T @ lost / len(gap) - 2 * decay * ahead)
        ahead = new + (k - 1) / (k + 2) * (new - w)
        w = new
    return w


def rank(x: np.ndarray, good: np.ndarray, share_bad: float, pairs: int = PAIRS) -> Ranking | None:
    """Learn from measurements and labels; ``share_bad`` is the quantile that the threshold takes."""
    if good.all() or not good.any():
        return None
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    scaled = np.clip((x - centre) / spread, -8, 8)
    draw = np.random.default_rng(7)
    a, b = draw.choice(np.flatnonzero(good), pairs), draw.choice(np.flatnonzero(~good), pairs)
    w = bradley_terry(scaled[a], scaled[b])
    strength = scaled @ w
    each = np.where(good, (1 - share_bad) / good.sum(), share_bad / (~good).sum())  # as the labels are in the table
    order = np.argsort(strength, kind="stable")
    cut = int(np.searchsorted(np.cumsum(each[order]), share_bad))
    low, high = strength[order[max(0, cut - 1)]], strength[order[min(cut, len(order) - 1)]]
    return Ranking(w, centre, spread, float((low + high) / 2), 1.0)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = [measure(t) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("good"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "good", "x"])


def learn(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Ranking | None:
    """Fit on at most ``per_label`` documents of each value of ``labels.quality`` (doc_id, quality)."""
    rows = labels.select("doc_id", F.col("quality").alias("good")).where("good in (0, 1)")
    shares = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return None
    chosen = sample_per_class(rows, "good", per_label)
    # at most two times per_label narrow rows, so they may be sent to every task
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = sample.mapInArrow(_measured, "doc_id long, good int, x array<double>").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    x = np.array(got["x"].to_pylist())
    return rank(x, got["good"].to_numpy() == 1, shares[0] / (shares[0] + shares[1]))


def score(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    if ranking is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            value = ranking.score(np.array([measure(t) for t in part.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(F.col("doc_id").isNotNull() & ~is_remainder(F.col("doc_id"), 3, 1))
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", is_remainder(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
