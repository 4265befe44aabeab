"""Article curation: names, nulls, length filters, duplicates, statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.functions.text import word_count
from textfacts.operators.columns import with_columns_once
from textfacts.operators.ordering import row_key


def clean_headers(df: DataFrame) -> DataFrame:
    """Strip header names and drop line breaks from them."""
    return df.toDF(*[name.strip().replace("\n", "") for name in df.columns])


def standard_columns(df: DataFrame, renames: Mapping[str, str] = C.RENAMES) -> DataFrame:
    return clean_headers(df).withColumnsRenamed(dict(renames))


def drop_missing(df: DataFrame, columns: Sequence[str] = C.REQUIRED_COLUMNS) -> DataFrame:
    return df.dropna(subset=list(columns))


def with_word_counts(df: DataFrame) -> DataFrame:
    return with_columns_once(
        df,
        {
            "summary_word_count": word_count("summary"),
            "article_word_count": word_count("article"),
        },
    )


def summary_length_ok() -> Column:
    return F.col("summary_word_count").between(C.MIN_SUMMARY_WORDS, C.MAX_SUMMARY_WORDS)


def article_length_ok() -> Column:
    return F.col("article_word_count") >= C.MIN_ARTICLE_WORDS


def headline_length_ok() -> Column:
    return F.length("headline") >= C.MIN_HEADLINE_CHARS


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of equal rows, nulls counting as equal.

    Rows meet by a 32-byte hash of all their columns; no text is a key.
    Copies are folded together before the shuffle, so a row with very many
    copies sends one row per input partition.
    """
    return df.withColumn("_row", F.unhex(row_key(df.columns))).dropDuplicates(["_row"]).drop("_row")


def curate(raw: DataFrame) -> DataFrame:
    """Curated articles with ``row_key``, a unique hash of the whole input row.

    The filters look at one row at a time, so they give the same rows before
    and after removing duplicates; run first, they keep rejected text out of
    the shuffle.
    """
    named = standard_columns(raw)
    kept = (
        with_word_counts(drop_missing(named))
        .where(summary_length_ok())
        .where(article_length_ok())
        .where(headline_length_ok())
    )
    return kept.withColumn("row_key", row_key(named.columns)).dropDuplicates(["row_key"])


FUNNEL_STEPS = (
    "read", "deduplicated", "complete", "summary_length", "article_length", "headline_length",
)


def filter_funnel(raw: DataFrame) -> DataFrame:
    """Rows left after each curation step, from one pass.

    Rows shrink to a 32-byte hash and four flags before the only shuffle; equal
    rows are folded together on both sides of it.
    """
    named = standard_columns(raw)
    flags = with_word_counts(named).select(
        F.unhex(row_key(named.columns)).alias("row_hash"),
        F.expr(" and ".join(f"{c} is not null" for c in C.REQUIRED_COLUMNS)).alias("ok1"),
        F.coalesce(summary_length_ok(), F.lit(False)).alias("ok2"),
        F.coalesce(article_length_ok(), F.lit(False)).alias("ok3"),
        F.coalesce(headline_length_ok(), F.lit(False)).alias("ok4"),
    )
    distinct = flags.groupBy("row_hash", "ok1", "ok2", "ok3", "ok4").agg(
        F.count(F.lit(1)).alias("copies")
    )
    passed, counts = F.lit(True), []
    for flag in ("ok1", "ok2", "ok3", "ok4"):
        passed = passed & F.col(flag)
        counts.append(F.count_if(passed))
    totals = distinct.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias(FUNNEL_STEPS[0]),
        F.count(F.lit(1)).alias(FUNNEL_STEPS[1]),
        *[c.alias(name) for c, name in zip(counts, FUNNEL_STEPS[2:])],
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(name).alias("n_rows"))
            for i, name in enumerate(FUNNEL_STEPS)
        ]
    )
    return totals.select(F.inline(rows))


def corpus_statistics(curated: DataFrame) -> DataFrame:
    """Row count, mean word counts, their ratio and the number of categories."""
    return curated.agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.avg("article_word_count").alias("avg_article_words"),
        F.avg("summary_word_count").alias("avg_summary_words"),
        F.count_distinct("category").alias("n_categories"),
    ).select(
        "n_articles",
        "avg_article_words",
        "avg_summary_words",
        (F.col("avg_article_words") / F.col("avg_summary_words")).alias("compression_ratio"),
        "n_categories",
    )


# What the corpus statistics are held against.
TARGETS = (
    ("n_articles", float(C.TARGET_ROWS), 0.0),
    ("avg_article_words", C.TARGET_ARTICLE_WORDS, C.TOLERANCE_ARTICLE_WORDS),
    ("avg_summary_words", C.TARGET_SUMMARY_WORDS, C.TOLERANCE_SUMMARY_WORDS),
    ("compression_ratio", C.TARGET_COMPRESSION, C.TOLERANCE_COMPRESSION),
)


def check_targets(
    statistics: DataFrame, targets: Sequence[tuple[str, float, float]] = TARGETS
) -> DataFrame:
    """One row per target: actual value, target, tolerance and whether they agree.

    A tolerance of zero asks for equality, any other for a smaller difference.
    """
    actual = statistics.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("actual"))
                    for name, _, _ in targets
                ]
            )
        )
    )
    wanted = statistics.sparkSession.createDataFrame(
        list(targets), "metric string, target double, tolerance double"
    )
    gap = F.abs(F.col("actual") - F.col("target"))
    return actual.join(wanted, "metric").withColumn(
        "matches", F.when(F.col("tolerance") == 0, gap == 0).otherwise(gap < F.col("tolerance"))
    )
