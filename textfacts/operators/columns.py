"""Adding costly columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns whose expressions run exactly once per row.

    A filter or projection on a computed column is normally rewritten in terms
    of its inputs, which repeats the expression wherever it is mentioned; for
    regular expressions over long texts that multiplies the work.  Here a plain
    projection makes the values, sharing what they have in common, and
    expanding a one-element array of them keeps the optimizer from taking
    later uses apart again.
    """
    held = {f"_made_{name}": value for name, value in columns.items()}
    row = F.struct(*[F.col(f"_made_{name}").alias(name) for name in columns])
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in columns],
        *[value.alias(name) for name, value in held.items()],
    ).select("*", F.inline(F.array(row))).drop(*held)
