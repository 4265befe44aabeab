"""Faithfulness scores of a summary against its source, as column expressions.

All of them look at one row, so scoring never shuffles.  Date, term and
mention columns come from :mod:`textfacts.functions.text`; make the source's
once per article, before several summaries are put beside it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from textfacts import constants as C


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _share(part: Column, whole: Column, empty: float) -> Column:
    """size(part)/size(whole), or ``empty`` when there is nothing to take a share of."""
    return F.when(F.size(whole) == 0, F.lit(empty)).otherwise(F.size(part) / F.size(whole))


def temporal_consistency(summary_dates: Column | str, source_dates: Column | str) -> Column:
    """Share of the summary's dates that the source has; 1 without dates."""
    found, given = _col(summary_dates), _col(source_dates)
    return _share(F.array_intersect(found, given), found, 1.0)


def invented_date_loss(summary_dates: Column | str, source_dates: Column | str) -> Column:
    """Share of the summary's dates that the source lacks; 0 without dates."""
    found, given = _col(summary_dates), _col(source_dates)
    return _share(F.array_except(found, given), found, 0.0)


def term_loss(summary_terms: Column | str, source_terms: Column | str) -> Column:
    """1 minus the share of the source's terms the summary keeps; 0 without terms."""
    kept, given = _col(summary_terms), _col(source_terms)
    return F.lit(1.0) - _share(F.array_intersect(given, kept), given, 1.0)


def entity_consistency(summary_mentions: Column | str, source_mentions: Column | str) -> Column:
    """Mean credit of the summary's mentions, repeats counting; 1 without mentions.

    A mention earns 1 if the source has the same text under the same type, or
    0.5 if, without regard to case, it is part of a source mention of its type.
    Pass the source's mentions without repeats.
    """
    ours, theirs = _col(summary_mentions), _col(source_mentions)

    def credit(mention: Column) -> Column:
        part = F.exists(
            theirs,
            lambda s: (s["type"] == mention["type"])
            & F.lower(s["text"]).contains(F.lower(mention["text"])),
        )
        return F.when(F.array_contains(theirs, mention), 1.0).when(part, 0.5).otherwise(0.0)

    total = F.aggregate(ours, F.lit(0.0), lambda acc, mention: acc + credit(mention))
    return F.when(F.size(ours) == 0, 1.0).otherwise(F.least(total / F.size(ours), F.lit(1.0)))


def semantic_loss(similarity: Column | str, missing_as_zero: bool = True) -> Column:
    """1 minus the cosine similarity, between 0 and 2.

    Without a similarity the loss is 0, or null with ``missing_as_zero`` off.
    """
    loss = F.lit(1.0) - _col(similarity)
    return F.coalesce(loss, F.lit(0.0)) if missing_as_zero else loss


def semantic_flag(similarity: Column | str, threshold: float = C.SEMANTIC_THRESHOLD) -> Column:
    return _col(similarity) >= threshold


def overall(
    entity: Column | str,
    temporal: Column | str,
    semantic: Column | str,
    weights: Mapping[str, float] = C.FACTUALITY_WEIGHTS,
) -> Column:
    """Weighted sum of the three consistencies; the weights must add up to 1."""
    if abs(sum(weights.values()) - 1.0) >= 0.001:
        raise ValueError(f"weights must add up to 1, got {sum(weights.values())}")
    return (
        F.lit(weights["entity"]) * _col(entity)
        + F.lit(weights["temporal"]) * _col(temporal)
        + F.lit(weights["semantic"]) * _col(semantic)
    )


def staged_total(
    stage: str,
    ce: Column | str = "ce",
    entity: Column | str = "entity",
    temporal: Column | str = "temporal",
    semantic: Column | str = "semantic",
    weights: Mapping[str, Mapping[str, float]] = C.STAGE_WEIGHTS,
) -> Column:
    """A training stage's weighted loss.

    Parts of weight 0 are not in the expression, so nothing computes them for
    a stage that does not use them.
    """
    parts = {"ce": ce, "entity": entity, "temporal": temporal, "semantic": semantic}
    total = None
    for name, part in parts.items():
        weight = weights[stage][name]
        if weight:
            term = F.lit(weight) * _col(part)
            total = term if total is None else total + term
    return F.lit(0.0) if total is None else total
