"""The (model, sample) grid: what is left to do, generation, failures, merging."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from textfacts import constants as C
from textfacts.functions import text as T
from textfacts.operators.examples import model_structs

#: Called once per task and model id; gives a function from a batch of texts to their summaries.
Summariser = Callable[[str], Callable[[list[str]], list[str]]]
BATCH_ROWS = 32


def per_text(summarise: Callable[[str, str], str]) -> Summariser:
    """A summariser from a function of one model id and one text."""
    return lambda model_id: lambda texts: [summarise(model_id, text) for text in texts]


def pending_models(
    samples: DataFrame, done: DataFrame, sample_id: str, models: Mapping[str, str] = C.MODELS
) -> DataFrame:
    """Samples some model has no finished row for, with those models as ``pending``.

    Finished rows fold to one short list of models per sample, so each sample
    is shuffled once instead of once per model.
    """
    finished = done.groupBy(sample_id).agg(F.collect_set("model_name").alias("done_models"))
    left = F.filter(
        model_structs(models),
        lambda m: ~F.coalesce(F.array_contains("done_models", m["model_name"]), F.lit(False)),
    )
    joined = samples.join(finished, sample_id, "left")
    return joined.select(*samples.columns, left.alias("pending")).where(F.size("pending") > 0)


def pending_grid(
    samples: DataFrame, done: DataFrame, sample_id: str, models: Mapping[str, str] = C.MODELS
) -> DataFrame:
    """One row per sample and model that has no finished row for it.

    Pairs already done are never made.
    """
    return expand_pending(pending_models(samples, done, sample_id, models))


def expand_pending(waiting: DataFrame) -> DataFrame:
    return waiting.select("*", F.inline("pending")).drop("pending")


def with_status(df: DataFrame, article: str, reference: str) -> DataFrame:
    """Add ``status`` and ``error``: rows lacking a text are failures, not dropped."""

    def empty(name: str) -> Column:
        return F.coalesce(F.length(name) == 0, F.lit(True))

    error = F.when(empty(article), "empty article").when(empty(reference), "empty reference")
    return df.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNull(), "ok").otherwise("failed")
    )


def lead_summary(
    text: Column | str,
    shortest: int = C.MIN_SUMMARY_LENGTH,
    longest: int = C.MAX_SUMMARY_LENGTH,
) -> Column:
    """Extractive summary: the leading third of the words, within the length limits."""
    found = T.words(text)
    return lead_of_words(found, F.size(found), shortest, longest)


def lead_of_words(
    found: Column | str,
    count: Column | str,
    shortest: int = C.MIN_SUMMARY_LENGTH,
    longest: int = C.MAX_SUMMARY_LENGTH,
) -> Column:
    """The same from a text's words, or its first ``longest`` ones, and how many it has."""
    third = F.floor((F.col(count) if isinstance(count, str) else count) / F.lit(3)).cast("int")
    return F.array_join(
        F.slice(found, F.lit(1), F.least(F.greatest(third, F.lit(shortest)), F.lit(longest))), " "
    )


def _told(failure: Exception) -> str:
    return f"{type(failure).__name__}: {failure}"


def _summarised(make: Callable[[list[str]], list[str]], texts: list[str]) -> list[str]:
    made = list(make(texts))
    if len(made) != len(texts):
        raise ValueError(f"{len(made)} summaries for {len(texts)} texts")
    return made


def in_order(rows: Sequence[int], size: int) -> list[list[int]]:
    return [list(rows[start : start + size]) for start in range(0, len(rows), size)]


def by_length(rows: Sequence[int], sizes: Sequence[float], budget: int) -> list[list[int]]:
    """Rows in batches of like length: rows times the longest stays within the budget, unless one row alone is longer."""
    batches: list[list[int]] = []
    for row in sorted(rows, key=lambda r: (sizes[r], r)):
        if batches and (len(batches[-1]) + 1) * sizes[row] <= budget:
            batches[-1].append(row)
        else:
            batches.append([row])
    return batches


def padded_by_batch(df: DataFrame, length: str, order: str, batch_rows: int = BATCH_ROWS, token_budget: int = 32_768, step: int = 64) -> DataFrame:
    """What padding costs per model: batches in key order, and batches of like length within a token budget.

    In key order, ``batch_rows`` neighbouring whole-number keys make a batch, padded to its longest row.  By length, rows
    whose lengths round up to the same multiple of ``step`` are batched together and padded to that multiple, so that
    batches need no sort.  Both are two narrow aggregations.
    """
    rows = df.where(F.col(length).isNotNull())
    plain = (
        rows.groupBy("model_name", F.floor(F.col(order) / batch_rows).alias("batch"))
        .agg(F.sum(length).alias("tokens"), (F.max(length) * F.count(F.lit(1))).alias("padded"))
        .groupBy("model_name")
        .agg(F.sum("tokens").alias("tokens"), F.sum("padded").alias("padded_in_order"), F.count(F.lit(1)).alias("batches_in_order"))
    )
    room = F.greatest(F.ceil(F.col(length) / step), F.lit(1)) * step
    like = (
        rows.groupBy("model_name", room.alias("room"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("per_batch", F.greatest(F.floor(F.lit(token_budget) / F.col("room")), F.lit(1)))
        .groupBy("model_name")
        .agg(F.sum(F.col("n") * F.col("room")).alias("padded_by_length"), F.sum(F.ceil(F.col("n") / F.col("per_batch"))).alias("batches_by_length"))
    )
    return plain.join(like, "model_name")


def generate(
    df: DataFrame,
    summarise: Summariser,
    article: str = "article",
    model_id: str = "model_id",
    batch_rows: int = BATCH_ROWS,
    token_budget: int | None = None,
    length: str = "input_length",
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Run a summariser over the rows of status ``ok``, ``batch_rows`` at a time.

    With a ``token_budget`` the rows of an Arrow batch are taken by their
    ``length`` instead, as many at a time as fit the budget when all are padded
    to the longest (a longer row goes alone); the rows come out in their own
    order.  ``profile`` asks for the resources a model needs, such as a
    graphics card per task, for this stage only.

    Adds ``generated_summary`` and ``duration_ms`` (a row's share of its
    batch).  ``summarise`` loads a model once per task; if that raises, the
    model's rows in the task are failures with the error's text.  If a batch
    raises, its rows are tried one by one, and only those that raise again
    fail; the job goes on.
    """
    schema = t.StructType(
        [*df.schema.fields, t.StructField("generated_summary", t.StringType()), t.StructField("duration_ms", t.DoubleType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Callable | Exception] = {}
        for batch in batches:
            rows = len(batch)
            made, took = [None] * rows, [None] * rows
            models, texts = batch[model_id].tolist(), batch[article].tolist()
            status, error = batch["status"].tolist(), batch["error"].tolist()
            sizes = batch[length].fillna(0).tolist() if token_budget else None
            waiting: dict[str, list[int]] = {}
            for row in range(rows):
                if status[row] == "ok":
                    waiting.setdefault(models[row], []).append(row)

            def attempt(make, chosen):
                start = time.perf_counter()
                found = _summarised(make, [texts[row] for row in chosen])
                spent = (time.perf_counter() - start) * 1000.0 / len(chosen)
                for row, summary in zip(chosen, found):
                    made[row], took[row] = summary, spent

            for model, chosen in waiting.items():
                if model not in loaded:
                    try:
                        loaded[model] = summarise(model)
                    except Exception as failure:  # noqa: BLE001 - a model that does not load is recorded
                        loaded[model] = failure
                make = loaded[model]
                parts = by_length(chosen, sizes, token_budget) if token_budget else in_order(chosen, batch_rows)
                for part in parts:
                    if isinstance(make, Exception):
                        for row in part:
                            status[row], error[row] = "failed", f"model not loaded: {_told(make)}"
                        continue
                    try:
                        attempt(make, part)
                    except Exception:  # noqa: BLE001 - the rows are tried again one by one
                        for row in part:
                            try:
                                attempt(make, [row])
                            except Exception as failure:  # noqa: BLE001 - any failure is recorded
                                status[row], error[row] = "failed", _told(failure)
            yield batch.assign(status=status, error=error, generated_summary=made, duration_ms=took)

    return df.mapInPandas(run, schema, profile=profile)


def merge_results(earlier: DataFrame, new: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """Earlier and new result rows, the earlier one where a pair occurs in both.

    Both sides are narrowed to keys for the check, which keeps result texts
    out of the join's other side.
    """
    keys = ["model_name", sample_id]
    fresh = new.join(earlier.select(*keys), keys, "left_anti")
    return earlier.unionByName(fresh)
