"""Resumable evaluation of summarisers over a sample set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.functions import text as T
from textfacts.functions.rouge import METRICS, rouge
from textfacts.operators import grid
from textfacts.operators.columns import with_columns_once
from textfacts.operators.examples import with_input_lengths
from textfacts.operators.grouping import concat_documents
from textfacts.operators.report import run_aggregates
from textfacts.session import work_path
from textfacts.sources import manifest
from textfacts.sources.results import (
    all_predictions,
    append_predictions,
    current_rows,
    prediction_schema,
)


def evaluate_rows(
    todo: DataFrame,
    summarise: grid.Summariser | None = None,
    metrics: tuple[str, ...] = METRICS,
    stemmed: bool = True,
    token_budget: int | None = None,
) -> DataFrame:
    """Prediction rows for (sample_id, article, summary, n_words, model_name, model_id) rows.

    ``n_words`` is the article's word count; a prompt in front adds its own words.
    Without a summariser the extractive lead summary is used, which stays in
    built-in expressions.  Rows that have the article's first words as
    ``lead_words`` (:func:`with_article_words`) are not split again per model.
    """
    checked = grid.with_status(todo, "article", "summary").withColumn(
        "article", T.with_prompt("article", "model_id")
    )
    prompt_words = T.with_prompt(F.lit(""), "model_id") != ""
    tokens = F.col("n_words") + F.when(prompt_words, len(C.PROMPT_PREFIX.split())).otherwise(0)
    sized = with_input_lengths(checked.withColumn("n_tokens", tokens), "n_tokens")
    if summarise is None:
        good = F.col("status") == "ok"
        if "lead_words" in todo.columns:
            prompt = F.when(prompt_words, F.array(*map(F.lit, C.PROMPT_PREFIX.split()))).otherwise(F.array().cast("array<string>"))
            lead = grid.lead_of_words(F.concat(prompt, "lead_words"), "n_tokens")
        else:
            lead = grid.lead_summary("article")
        made = sized.withColumn(
            "generated_summary", F.when(good, lead)
        ).withColumn("duration_ms", F.lit(None).cast("double"))
    else:
        made = grid.generate(sized, summarise, token_budget=token_budget, length="padded_length")
    reference = F.when(F.col("generated_summary").isNotNull(), F.col("summary"))
    scored = made.withColumn("scores", rouge(reference, "generated_summary", metrics, stemmed))
    return scored.select(
        "sample_id",
        "model_name",
        "model_id",
        T.preview("article").alias("article_preview"),
        F.col("summary").alias("reference_summary"),
        "generated_summary",
        F.col("input_length").cast("long").alias("input_length"),
        F.col("padded_length").cast("long").alias("padded_length"),
        *[F.col("scores")[m].alias(m) for m in METRICS],
        "status",
        "error",
        "duration_ms",
    )


def with_article_words(samples: DataFrame, lead: bool) -> DataFrame:
    """Add the article's word count ``n_words`` and, if asked for, its first words ``lead_words``: as many as a summary has."""
    split = with_columns_once(samples, {"_words": T.words("article")})
    made = {"n_words": F.when(F.col("article").isNotNull(), F.size("_words"))}
    if lead:
        made["lead_words"] = F.slice("_words", 1, C.MAX_SUMMARY_LENGTH)
    return with_columns_once(split, made).drop("_words")


def run_evaluation(
    samples: DataFrame,
    path: str,
    models: Mapping[str, str] = C.MODELS,
    summarise: grid.Summariser | None = None,
    metrics: tuple[str, ...] = METRICS,
    stemmed: bool = True,
    resume: bool = True,
    retry_failed: bool = False,
    commits: int = 1,
    published: bool = False,
    token_budget: int | None = None,
) -> DataFrame:
    """Evaluate what the table at ``path`` lacks, add it there, return the results.

    ``samples`` has a unique ``sample_id``, ``article`` and ``summary``.  Each of
    the ``commits`` hash slices of the samples is one append, so an interrupted
    run keeps the slices it finished, and the next call does only the rest.
    With several, what is to do is stored once by slice, so the samples are read
    once and each commit reads its slice only.
    With ``resume`` off everything is done again and the newest rows count.
    With ``published`` a slice counts only when all of its rows are written, even
    if the driver dies in between; see :mod:`textfacts.sources.manifest`.  A
    table is either published or not for all of its life.  ``token_budget``
    batches a summariser's inputs by length.
    """
    spark = samples.sparkSession
    run_id = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S.%f")
    id_type = samples.schema["sample_id"].dataType.simpleString()
    stored_rows = manifest.published_predictions if published else all_predictions
    if resume:
        finished = stored_rows(spark, path, id_type)
    else:
        finished = spark.createDataFrame([], prediction_schema(id_type))
    if retry_failed:
        finished = finished.where("status = 'ok'")
    done = finished.select("model_name", "sample_id")
    waiting = grid.pending_models(samples, done, "sample_id", models)
    slices = [waiting]
    if commits > 1:
        stored = work_path(spark, "pending")
        sliced = waiting.withColumn("slice", F.pmod(F.xxhash64("sample_id"), F.lit(commits)).cast("int"))
        sliced.write.partitionBy("slice").parquet(stored)
        read = spark.read.schema(sliced.schema).parquet(stored)
        slices = [read.where(F.col("slice") == part).drop("slice") for part in range(commits)]
    for part, chosen in enumerate(slices):
        # articles are split after finished samples are gone and before each is repeated per model
        counted = with_article_words(chosen, lead=summarise is None)
        rows = evaluate_rows(grid.expand_pending(counted), summarise, metrics, stemmed, token_budget).withColumn("run_id", F.lit(run_id))
        if published:
            manifest.write_slice(rows, path, f"{run_id}-{part}")
        else:
            append_predictions(rows, path)
    return current_rows(stored_rows(spark, path, id_type))


def event_samples(
    documents: DataFrame, event: str, article: str, order: Sequence[str], summary: str
) -> DataFrame:
    """Samples of an event each: its first articles joined, with the reference of the first of them."""
    joined = concat_documents(documents, event, article, order)
    first = documents.groupBy(event).agg(F.min_by(summary, F.struct(*order)).alias("summary"))
    return joined.join(first, event).select(
        F.col(event).alias("sample_id"), F.col("document").alias("article"), "summary"
    )


def evaluation_scores(results: DataFrame, places: int | None = 2) -> DataFrame:
    """Aggregate scores per model, rounded as they are published."""
    totals = run_aggregates(results, METRICS)
    if places is None:
        return totals
    one_place, whole = ("padding_overhead_percent",), ("avg_input_length", "avg_padded_length")
    digits = {c: places for c, kind in totals.dtypes if kind == "double"}
    digits.update({c: 1 for c in one_place})
    digits.update({c: 0 for c in whole})
    return totals.withColumns({c: F.round(c, d) for c, d in digits.items()})
