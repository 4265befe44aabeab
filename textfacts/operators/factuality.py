"""Factuality scoring of (article, summary) rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.functions import factuality as fact
from textfacts.functions import text as T
from textfacts.operators.columns import with_columns_once

# Which vocabulary categories name what kind of entity.
GAZETTEER = {
    "PERSON": C.VOCABULARY["titles"],
    "ORG": C.VOCABULARY["political"] + C.VOCABULARY["institutions"],
    "GPE": C.VOCABULARY["admin"],
}

_FEATURES = {
    "dates": lambda text: T.date_mentions(text),
    "date_words": lambda text: T.date_mentions(text, year=T.WORD_YEAR),
    "terms": lambda text: T.vocabulary_terms(text),
}


def add_features(
    df: DataFrame,
    text: str,
    prefix: str,
    features: Sequence[str] = ("dates", "date_words", "terms", "mentions"),
    gazetteer: Mapping[str, Sequence[str]] = GAZETTEER,
) -> DataFrame:
    """Columns ``<prefix>_dates``, ``_date_words``, ``_terms``, ``_mentions`` of a text."""
    columns = {}
    for name in features:
        if name == "mentions":
            columns[f"{prefix}_mentions"] = T.typed_mentions(text, gazetteer)
        else:
            columns[f"{prefix}_{name}"] = _FEATURES[name](text)
    return with_columns_once(df, columns)


def add_source_features(df: DataFrame, text: str, **options) -> DataFrame:
    """Source features, mentions once each: only their presence matters."""
    made = add_features(df, text, "source", **options)
    if "source_mentions" not in made.columns:
        return made
    return made.withColumn("source_mentions", F.array_distinct("source_mentions"))


def consistency_scores(features: DataFrame, similarity: Column | str) -> DataFrame:
    """Add entity, temporal, semantic and overall scores to feature rows."""
    return features.withColumns(
        {
            "entity": fact.entity_consistency("summary_mentions", "source_mentions"),
            "temporal": fact.temporal_consistency("summary_dates", "source_dates"),
            "semantic": F.col(similarity) if isinstance(similarity, str) else similarity,
        }
    ).withColumn("overall", fact.overall("entity", "temporal", "semantic"))


def rounded(df: DataFrame, columns: Sequence[str], places: int = 3) -> DataFrame:
    """Scores as they are shown; compute further on the unrounded ones."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def loss_parts(features: DataFrame, similarity: Column | str, missing_as_zero: bool = True) -> DataFrame:
    """Add entity, temporal and semantic losses to feature rows.

    Without a similarity the semantic loss is 0, or null with ``missing_as_zero`` off.
    """
    return features.withColumns(
        {
            "entity": fact.term_loss("summary_terms", "source_terms"),
            "temporal": fact.invented_date_loss("summary_date_words", "source_date_words"),
            "semantic": fact.semantic_loss(similarity, missing_as_zero),
        }
    )


def staged_losses(
    parts: DataFrame, weights: Mapping[str, Mapping[str, float]] = C.STAGE_WEIGHTS
) -> DataFrame:
    """One row per stage with its weighted ``total``; the weights are literals."""
    totals = F.array(
        *[
            F.struct(F.lit(stage).alias("stage"), fact.staged_total(stage, weights=weights).alias("total"))
            for stage in weights
        ]
    )
    return parts.select("*", F.inline(totals))


def terms_by_category(
    df: DataFrame, terms: str, vocabulary: Mapping[str, Sequence[str]] = C.VOCABULARY
) -> DataFrame:
    """Per category: how often its terms were found, and how many different ones."""
    per_term = with_columns_once(df, {"terms": F.col(terms)}).select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_found")
    )
    listed = df.sparkSession.createDataFrame(
        T.vocabulary_rows(vocabulary), "category string, term string"
    )
    return (
        listed.join(per_term, "term", "left")
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("n_terms"),
            F.count("n_found").alias("n_terms_found"),
            F.coalesce(F.sum("n_found"), F.lit(0)).alias("n_mentions"),
        )
    )
