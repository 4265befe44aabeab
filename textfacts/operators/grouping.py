"""Several articles about one event as one input text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textfacts import constants as C


MERGE_GROUPS = 64


def concat_documents(
    df: DataFrame,
    event: str,
    article: str,
    order: Sequence[str],
    limit: int = C.MAX_DOCUMENTS_PER_EVENT,
    separator: str = C.DOCUMENT_SEPARATOR,
    merge_groups: int = MERGE_GROUPS,
) -> DataFrame:
    """One row per event: its first ``limit`` articles in order, joined.

    Missing articles use up a place and are then left out.  Each input
    partition sends ``limit`` articles of an event at most.  Those of one event
    first meet in ``merge_groups`` tasks, which cut them again, so an event
    with articles in every partition is not left to a single task.  With
    ``merge_groups=1`` that step is left out, which suits small events.
    """
    rows = df.select(event, article, *order)
    if merge_groups > 1:
        rows = rows.withColumn("part", F.spark_partition_id() % merge_groups)
        rows = _first(rows, [event, "part"], order, limit)
    listed = F.array_sort(F.collect_list(F.struct("place", F.col(article).alias("article"))))
    return _first(rows, [event], order, limit).groupBy(event).agg(listed.alias("parts")).select(
        event,
        F.array_join(F.transform("parts", lambda p: p["article"]), separator).alias("document"),
        F.size(F.filter("parts", lambda p: p["article"].isNotNull())).alias("n_documents"),
    )


def _first(df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Rows with ``place`` up to ``limit`` in their group."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= limit)
