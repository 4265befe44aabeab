"""Score tables: aggregates per model, leaderboard, comparisons, loss logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.functions.text import contains_text


# Fixed value: how a checkpoint folder shows its step.
CHECKPOINT_STEP = r"checkpoint-(\d+)"


def score_summary(
    df: DataFrame, by: str, metrics: Sequence[str], scale: float = 100.0
) -> DataFrame:
    """Mean and population standard deviation per group, times ``scale``, unrounded."""
    return df.groupBy(by).agg(*score_aggregates(metrics, scale))


def score_aggregates(metrics: Sequence[str], scale: float = 100.0) -> list[Column]:
    return [
        column
        for m in metrics
        for column in (
            (F.avg(m) * scale).alias(f"{m}_mean"),
            (F.stddev_pop(m) * scale).alias(f"{m}_std"),
        )
    ]


def success_aggregates() -> list[Column]:
    """Samples, successes, failures and the success percentage, from ``status``."""
    ok = F.count_if(F.col("status") == "ok")
    return [
        F.count(F.lit(1)).alias("total_samples"),
        ok.alias("successful_samples"),
        F.count_if(F.col("status") != "ok").alias("failed_samples"),
        (ok / F.count(F.lit(1)) * 100).alias("success_rate"),
    ]


def length_aggregates() -> list[Column]:
    """Mean input and padded length of the good rows, and the padding overhead in percent."""
    good = F.col("status") == "ok"
    n = F.count_if(good)
    raw = F.sum(F.when(good, F.col("input_length")))
    padded = F.sum(F.when(good, F.col("padded_length")))
    mean_raw = F.when(n > 0, raw / n).otherwise(0.0)
    mean_padded = F.when(n > 0, padded / n).otherwise(0.0)
    overhead = F.when(mean_raw > 0, (mean_padded - mean_raw) / mean_raw * 100).otherwise(0.0)
    return [
        mean_raw.alias("avg_input_length"),
        mean_padded.alias("avg_padded_length"),
        overhead.alias("padding_overhead_percent"),
    ]


def time_aggregates() -> list[Column]:
    """Total and mean generation seconds over the rows that were timed; null if none was."""
    return [
        (F.sum("duration_ms") / 1000).alias("evaluation_time_seconds"),
        (F.avg("duration_ms") / 1000).alias("time_per_sample"),
    ]


def run_aggregates(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per model with date, counts, scores, times and lengths, in one aggregation.

    The evaluation date is the day of the newest run that the rows came from.
    """
    return results.groupBy("model_name", "model_id").agg(
        F.date_format(F.to_date(F.substring(F.max("run_id"), 1, 8), "yyyyMMdd"), "yyyy-MM-dd").alias("evaluation_date"),
        *success_aggregates(),
        *score_aggregates(metrics),
        *time_aggregates(),
        *length_aggregates(),
    )


def hours(seconds: Column | str) -> Column:
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.round(seconds / 3600, 2)


def leaderboard(scores: DataFrame, metric: str = "rouge2_mean", model: str = "model_name") -> DataFrame:
    """Scores with ``rank`` first: best metric first, then by name.

    For tables of one row per model.
    """
    place = F.row_number().over(W.orderBy(F.desc(metric), F.asc(model)))
    return scores.select(place.alias("rank"), *scores.columns)


def with_tier(board: DataFrame, selected: str = "LED", model: str = "model_name") -> DataFrame:
    """Add the medal of the first three ranks and the flag of the selected family."""
    tier = F.when(F.col("rank") == 1, "GOLD").when(F.col("rank") == 2, "SILVER")
    return board.withColumn(
        "tier", tier.when(F.col("rank") == 3, "BRONZE").otherwise("")
    ).withColumn("selected", contains_text(model, selected))


def best_model(scores: DataFrame, metric: str = "rouge2_mean", model: str = "model_name") -> DataFrame:
    """The one row with the best metric, ties going to the first name."""
    row = F.struct(*scores.columns)
    best = scores.agg(F.min_by(row, F.struct(-F.col(metric), F.col(model))).alias("best"))
    return best.select("best.*")


def named_models(scores: DataFrame, part: str, model: str = "model_name") -> DataFrame:
    return scores.where(contains_text(model, part))


def board_statistics(board: DataFrame) -> DataFrame:
    """Totals over a leaderboard."""
    return board.agg(
        F.count(F.lit(1)).alias("n_models"),
        F.count_if(F.col("success_rate") == 100.0).alias("n_full_success"),
        F.sum("successful_samples").alias("n_successful"),
        F.sum("failed_samples").alias("n_failed"),
        F.avg("rouge2_mean").alias("avg_rouge2"),
        F.sum("time_hours").alias("total_hours"),
    )


def missing_models(expected: DataFrame, found: DataFrame, model: str = "model_name") -> DataFrame:
    """Expected models nothing was found for."""
    return expected.join(found.select(model).distinct(), model, "left_anti")


def against_published(ours: DataFrame, published: DataFrame, by: str, metric: str) -> DataFrame:
    """Our metric beside the published one, with the change in percent."""
    other = published.select(by, F.col(metric).alias("published"))
    return ours.select(by, F.col(metric).alias("ours")).join(other, by).withColumn(
        "change_percent", (F.col("ours") - F.col("published")) / F.col("published") * 100
    )


def system_comparison(
    df: DataFrame, by: str, losses: Mapping[str, str], baseline: str, proposed: str
) -> DataFrame:
    """Mean of 1 - loss for two systems, in percent, and the difference in points.

    ``losses`` maps a metric's name to its loss column.
    """

    def mean_for(system: str, loss: str) -> Column:
        return F.avg(F.when(F.col(by) == system, 1 - F.col(loss))) * 100

    one_row = df.where(F.col(by).isin(baseline, proposed)).agg(
        *[mean_for(baseline, loss).alias(f"{name}_b") for name, loss in losses.items()],
        *[mean_for(proposed, loss).alias(f"{name}_p") for name, loss in losses.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(f"{name}_b").alias("baseline"),
                F.col(f"{name}_p").alias("proposed"),
                (F.col(f"{name}_p") - F.col(f"{name}_b")).alias("points"),
            )
            for name in losses
        ]
    )
    return one_row.select(F.inline(rows))


def loss_is_due(batch: Column | str, stage: Column | str, every: int = C.LOSS_EVERY) -> Column:
    """Are the costly loss parts computed for this batch?  Never in the warm-up stage."""
    batch = F.col(batch) if isinstance(batch, str) else batch
    stage = F.col(stage) if isinstance(stage, str) else stage
    return (batch % every == 0) & (stage != C.WARMUP_STAGE)


def epoch_means(
    log: DataFrame,
    by: Sequence[str] = ("stage", "epoch"),
    components: Sequence[str] = C.LOSS_COMPONENTS,
    mode: str = "zero_filled",
) -> DataFrame:
    """Mean of each loss component per stage and epoch.

    ``zero_filled`` averages over all batches, batches without computed parts
    counting as zero; ``computed_only`` averages the parts over the batches
    flagged ``computed`` (cross-entropy is there for every batch).
    """
    if mode not in ("zero_filled", "computed_only"):
        raise ValueError(f"unknown mode {mode!r}")

    def value(name: str) -> Column:
        if mode == "computed_only" and name != "ce":
            return F.when(F.col("computed"), F.col(name))
        return F.col(name)

    return log.groupBy(*by).agg(*[F.avg(value(c)).alias(f"{c}_mean") for c in components])


def latest_checkpoint(paths: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The path with the greatest step number, per group; of equal steps the path that sorts last."""
    step = F.regexp_extract(path, CHECKPOINT_STEP, 1).try_cast("long")
    return (
        paths.select(*by, F.col(path), step.alias("step"))
        .where("step is not null")
        .groupBy(*by)
        .agg(F.max(F.struct("step", path)).alias("last"))
        .select(*by, F.col("last")[path].alias(path), "last.step")
    )
