"""From raw articles to curated, split and stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textfacts.operators import curation
from textfacts.operators.ordering import first_by_date, positional_split
from textfacts.session import materialise
from textfacts.sources.tables import write_splits


def curated_articles(raw: DataFrame, cap: int | None = None) -> DataFrame:
    """Curated articles as a stored table, cut to the first ``cap`` by date.

    Curation shuffles the surviving text once; storing the outcome lets the
    later key passes read two narrow columns instead of repeating that.
    """
    table = materialise(curation.curate(raw), "curated")
    return table if cap is None else first_by_date(table, "date", "row_key", cap)


def split_articles(raw: DataFrame, cap: int | None = None) -> DataFrame:
    """Curated articles with ``split`` and ``small``; ``cap`` keeps only the first rows by date."""
    return positional_split(curated_articles(raw), "date", "row_key", cap)


def prepare_dataset(raw: DataFrame, path: str, cap: int | None = None) -> None:
    """Curate, split and write the dataset."""
    write_splits(split_articles(raw, cap), path)
