"""Text expressions.  Built-in Spark expressions, but for dates, terms and mentions, which are Arrow functions over whole batches."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.functions.dates import (
    ANY_YEAR,
    DAY_FIRST_DATE,
    MONTH_FIRST_DATE,
    MONTH_OF_DATE,
    NUMERIC_DATE,
    WORD_YEAR,
    DatePattern,
    find_dates,
)
from textfacts.functions.mentions import DATES, NameGrammar, find_mentions
from textfacts.functions.terms import find_terms

# The white-space characters Python's str.split() splits on.
# They are listed one by one and not as ranges because Java then tests all of
# them with one table look-up; \p{Z} adds the separators beyond Latin-1.
WHITESPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\p{Z}]"
NOT_TOKEN = "[^a-z0-9]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """White-space separated words, as Python's ``str.split()`` gives them."""
    return F.array_remove(F.split(_col(text), WHITESPACE + "+"), "")


def word_count(text: Column | str) -> Column:
    """Number of words; null for null text."""
    text = _col(text)
    return F.when(text.isNotNull(), F.size(words(text)))


def truncate_chars(text: Column | str, limit: int) -> Column:
    return F.substring(_col(text), 1, limit)


def preview(text: Column | str, limit: int = C.PREVIEW_CHARS) -> Column:
    return F.concat(truncate_chars(text, limit), F.lit(C.PREVIEW_SUFFIX))


def slug(name: Column | str) -> Column:
    """Folder-safe name: lower case with ``/`` and ``-`` as ``_``."""
    return F.translate(F.lower(_col(name)), "/-", "__")


def is_long_context(model_id: Column | str) -> Column:
    return F.lower(_col(model_id)).contains(C.LONG_CONTEXT_FAMILY)


def with_prompt(text: Column | str, model_id: Column | str) -> Column:
    """Put the task prefix before the text for the model family that wants it."""
    text = _col(text)
    return F.when(
        F.lower(_col(model_id)).contains(C.PROMPT_FAMILY),
        F.concat(F.lit(C.PROMPT_PREFIX), text),
    ).otherwise(text)


def contains_text(column: Column | str, part: str) -> Column:
    """Substring test that is false, not null, for null values."""
    return F.coalesce(_col(column).contains(part), F.lit(False))


def date_mentions(
    text: Column | str,
    year: DatePattern = ANY_YEAR,
    full_dates: bool = False,
    patterns: Sequence[DatePattern] | None = None,
    reach: int = 1,
) -> Column:
    """Distinct date mentions as strings.

    Three patterns are tried: numeric dates, four-digit years (anywhere, or as
    a word of their own with ``year=WORD_YEAR``) and month-name dates.  A
    month-name date is reported by its month abbreviation as written ("May",
    "jun"), which is what scoring compares; ``full_dates`` reports the whole
    mention instead and adds day-first dates.  ``patterns`` replaces the list;
    see :mod:`textfacts.functions.dates` for ``reach``.  Null text has no dates.
    """
    if patterns is None:
        patterns = [NUMERIC_DATE, year, MONTH_FIRST_DATE if full_dates else MONTH_OF_DATE]
        if full_dates:
            patterns.append(DAY_FIRST_DATE)
    return find_dates(_col(text), patterns, reach)


def vocabulary_rows(vocabulary: Mapping[str, Sequence[str]] = C.VOCABULARY) -> list[tuple[str, str]]:
    """(category, lower-cased term) in listing order, each term once per category."""
    return list(dict.fromkeys((cat, t.lower()) for cat, terms in vocabulary.items() for t in terms))


def vocabulary_terms(
    text: Column | str,
    terms: Iterable[str] | None = None,
    match: str = "substring",
) -> Column:
    """Distinct vocabulary terms found in the text, in vocabulary order.

    ``match='substring'`` finds a term anywhere, also inside a longer word;
    ``match='word'`` only where no letter or digit touches it.  Null text has
    no terms.  All terms are searched in one pass, however many there are; see
    :mod:`textfacts.functions.terms`.
    """
    if match not in ("substring", "word"):
        raise ValueError(f"match must be 'substring' or 'word', not {match!r}")
    chosen = [t for _, t in vocabulary_rows()] if terms is None else [t.lower() for t in terms]
    return find_terms(F.lower(_col(text)), chosen, word=match == "word")


def typed_mentions(
    text: Column | str,
    gazetteer: Mapping[str, Sequence[str]],
    dates: bool = True,
    grammar: NameGrammar | None = None,
) -> Column:
    """Entity mentions ``array<struct<type,text>>`` in the casing of the text.

    Each type's terms are found as whole words, without regard to case and
    with repeats; longer terms win over shorter ones starting at the same
    place.  With a ``grammar``, names beside titles and place words are
    mentions of their own.  Dates count as type ``DATE``.  Callers with a
    recogniser of their own supply such a column instead.
    """
    return find_mentions(_col(text), gazetteer, DATES if dates else (), grammar)


def rouge_tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits; everything else separates."""
    return F.array_remove(F.split(F.lower(_col(text)), NOT_TOKEN + "+"), "")
