"""From raw documents to token ids: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import table
from textfacts.llm.decontaminate import decontaminated
from textfacts.llm.language import UNKNOWN, learn_held_out, predict
from textfacts.llm.nearcopies import one_of_each
from textfacts.llm.passages import without_repeats
from textfacts.llm.pieces import encoded, load_vocabulary
from textfacts.session import materialise

#: A document whose language is less sure than this is rejected, as is one without a language.
MIN_LANGUAGE_SCORE = 0.5


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = f"_{name}"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the identifier knows and is more sure of than not."""
    told, score = _unused(docs, "lang_pred"), _unused(docs, "score")
    known = predict(docs, learn_held_out(docs), (told, score))
    return known.where((F.col(told) != UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand earlier in the corpus out of the texts; no document goes."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts."""
    return encoded(docs, load_vocabulary()).select("doc_id", "lang", "source", "ids")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("passages", passages),
    ("decontaminate", decontaminate),
    ("pieces", pieces),
]

#: No stage but the fourth could be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
