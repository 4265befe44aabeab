"""Result slices that count only once they are published.

A slice's rows go to a folder of their own attempt, and when they are all there one line in the manifest says so.  Readers
see the attempts that the manifest names and nothing else, so a driver that dies between writing and publishing leaves no
half slice behind: its folder is never looked at, and its pairs are still to do.  If two attempts at a slice are published,
the one published first counts.

    path/data/slice=<name>/attempt=<id>/model_name=<model>/...
    path/manifest/...json           one line a published attempt
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.sources.results import or_empty, prediction_schema

_ENTRY = "slice string, attempt string, published string, n_rows bigint"


def write_attempt(df: DataFrame, path: str, name: str) -> str:
    """Write a slice's rows where nobody looks yet; the attempt's id."""
    attempt = uuid.uuid4().hex
    df.write.partitionBy("model_name").parquet(_folder(path, name, attempt))
    return attempt


def _folder(path: str, name: str, attempt: str) -> str:
    return f"{path}/data/slice={name}/attempt={attempt}"


def publish(spark: SparkSession, path: str, name: str, attempt: str, n_rows: int | None = None) -> None:
    """Make an attempt the slice's rows.  The line is one file, which appears as a whole or not at all."""
    now = datetime.now(timezone.utc).isoformat()
    entry = spark.createDataFrame([(name, attempt, now, n_rows)], _ENTRY)
    entry.coalesce(1).write.mode("append").json(f"{path}/manifest")


def write_slice(df: DataFrame, path: str, name: str) -> None:
    publish(df.sparkSession, path, name, write_attempt(df, path, name))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The attempt that counts of every published slice."""
    entries = or_empty(spark, _ENTRY, lambda: spark.read.schema(_ENTRY).json(f"{path}/manifest"))
    first = F.min_by(F.struct("attempt", "published", "n_rows"), F.struct("published", "attempt"))
    return entries.groupBy("slice").agg(first.alias("first")).select("slice", "first.*")


def published_predictions(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """All rows of published slices.  Folders of other attempts are listed but not read."""
    schema = f"{prediction_schema(id_type)}, slice string, attempt string"
    rows = or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(f"{path}/data"))
    named = manifest(spark, path).select("slice", "attempt")
    return rows.join(F.broadcast(named), ["slice", "attempt"], "left_semi").drop("slice", "attempt")


def unpublished(spark: SparkSession, path: str) -> DataFrame:
    """(slice, attempt) folders that no reader sees: of dead runs, or of runs that are still at work."""
    schema = f"{prediction_schema('string')}, slice string, attempt string"
    rows = or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(f"{path}/data"))
    return rows.select("slice", "attempt").distinct().join(manifest(spark, path), ["slice", "attempt"], "left_anti")
