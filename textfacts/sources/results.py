"""Evaluation results: prediction tables, score files, leaderboards, loss logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textfacts.functions.text import slug
from textfacts.session import materialise

_PREDICTION_COLUMNS = (
    "model_id string, article_preview string, reference_summary string, "
    "generated_summary string, input_length bigint, padded_length bigint, "
    "rouge1 double, rouge2 double, rougeL double, "
    "status string, error string, duration_ms double, run_id string, model_name string"
)
SCORE_SCHEMA = (
    "model_name string, model_id string, evaluation_date string, total_samples bigint, "
    "successful_samples bigint, failed_samples bigint, success_rate double, "
    "rouge1_mean double, rouge2_mean double, rougeL_mean double, "
    "rouge1_std double, rouge2_std double, rougeL_std double, "
    "evaluation_time_seconds double, time_per_sample double, avg_input_length double, "
    "avg_padded_length double, padding_overhead_percent double"
)
LOSS_SCHEMA = (
    "epoch int, batch_idx bigint, computed boolean, ce double, entity double, "
    "temporal double, semantic double, total double, stage string"
)


def prediction_schema(id_type: str = "bigint") -> str:
    """Columns of a prediction table whose samples have ids of the given type."""
    return f"sample_id {id_type}, {_PREDICTION_COLUMNS}"


def or_empty(spark: SparkSession, schema: str, load) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return load()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_predictions(df: DataFrame, path: str) -> None:
    """Add result rows, one folder per model.  A failed job leaves no rows behind."""
    df.write.mode("append").partitionBy("model_name").parquet(path)


def all_predictions(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    schema = prediction_schema(id_type)
    return or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(path))


def current_rows(rows: DataFrame) -> DataFrame:
    """One row per model and sample: a good one before a failed one, then the newest run's."""
    newest = W.partitionBy("model_name", "sample_id").orderBy(
        F.desc(F.col("status") == "ok"), F.desc("run_id")
    )
    return rows.withColumn("place", F.row_number().over(newest)).where("place = 1").drop("place")


def current_predictions(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    return current_rows(all_predictions(spark, path, id_type))


def model_predictions(
    spark: SparkSession, path: str, model_name: str, id_type: str = "bigint"
) -> DataFrame:
    """Results of one model; only its folder is read."""
    return all_predictions(spark, path, id_type).where(F.col("model_name") == model_name)


def write_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Score rows as JSON lines, a folder per model.

    Two models whose names make the same folder are refused, not mixed.
    """
    folder = slug("model_name")
    clash = scores.select("model_name", folder.alias("folder")).distinct().groupBy("folder").agg(
        F.count(F.lit(1)).alias("names"), F.array_join(F.array_sort(F.collect_list("model_name")), ", ").alias("models")
    )
    found = clash.where("names > 1").first()
    if found:
        raise ValueError(f"models share the folder {found['folder']}: {found['models']}")
    scores.withColumn("folder", folder).write.mode(mode).partitionBy("folder").json(path)


def read_scores(spark: SparkSession, path: str, files: str = "*.json") -> DataFrame:
    """Score files below a folder, with the folder each came from.

    Reads what :func:`write_scores` wrote, all lines of it, and files that hold one indented JSON object: every file is
    one text, cut where an object ends and the next begins.
    """

    def load() -> DataFrame:
        options = {"wholetext": True, "recursiveFileLookup": True, "pathGlobFilter": files}
        return spark.read.format("text").options(**options).load(path).select("value", "_metadata.file_path")

    found = or_empty(spark, "value string, file_path string", load)
    objects = F.split(F.trim("value"), r"(?<=\})\s*\n\s*(?=\{)")
    # nested objects are followed by a comma or a bracket, never by another object's start
    one = found.select("file_path", F.explode(objects).alias("value")).where("trim(value) <> ''")
    rows = one.select(F.from_json("value", SCORE_SCHEMA).alias("row"), "file_path")
    folder = F.regexp_extract("file_path", r"([^/=]+)/[^/]*$", 1)
    return rows.select("row.*", folder.alias("folder"))


def model_scores(spark: SparkSession, path: str, model_name: str) -> DataFrame:
    """The score row of one finished model."""
    return read_scores(spark, path).where(F.col("model_name") == model_name)


def run_summary(
    scores: DataFrame, failed: DataFrame, date: str, author: str, test_samples: int | Column
) -> DataFrame:
    """One nested row: run metadata, the score rows, the names of failed models.

    Both inputs hold one row per model; ``test_samples`` may be a scalar subquery.
    """
    results = scores.agg(
        F.array_sort(F.collect_list(F.struct(*scores.columns))).alias("results")
    )
    names = failed.agg(F.array_sort(F.collect_list("model_name")).alias("failed_models"))
    return results.select(
        "results", names.scalar().alias("failed_models")
    ).select(
        F.struct(
            F.lit(date).alias("date"),
            F.lit(author).alias("author"),
            F.size("results").alias("num_models_evaluated"),
            F.size("failed_models").alias("num_models_failed"),
            (test_samples if isinstance(test_samples, Column) else F.lit(test_samples)).alias("test_samples"),
        ).alias("experiment_metadata"),
        "results",
        "failed_models",
    )


def write_leaderboard(
    board: DataFrame, path: str, summary_columns: Sequence[str], mode: str = "errorifexists"
) -> None:
    """The leaderboard as CSV and as JSON records, and chosen columns as a short CSV.

    The few rows are stored first, so the scores behind them are computed once.
    """
    ordered = materialise(board, "board").orderBy("rank")
    ordered.write.mode(mode).option("header", True).csv(f"{path}/leaderboard_csv")
    ordered.write.mode(mode).json(f"{path}/leaderboard_json")
    ordered.select(*summary_columns).write.mode(mode).option("header", True).csv(f"{path}/summary_csv")


def append_losses(log: DataFrame, path: str) -> None:
    """Add loss rows, one folder per training stage."""
    log.write.mode("append").partitionBy("stage").json(path)


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    return or_empty(spark, LOSS_SCHEMA, lambda: spark.read.schema(LOSS_SCHEMA).json(path))
