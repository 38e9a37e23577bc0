"""API error text to class, label, code and waiting time."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from shelfmark import fixed_values as fixed
from shelfmark.functions.text import contains_any


def _mentions(low: Column, words: list[str], word_match: bool) -> Column:
    if not word_match:
        return contains_any(low, words)
    joined = "|".join(re.escape(w) for w in words)
    return F.rlike(low, F.lit(f"(?<![a-z0-9])(?:{joined})(?![a-z0-9])"))


def error_class(message: Column, word_match: bool = False) -> Column:
    """quota before permanent before retryable before other.

    Words match inside longer words (``rate`` in ``generated``); ``word_match``
    asks for whole words instead.
    """
    low = F.lower(message)
    return (F.when(_mentions(low, fixed.QUOTA_WORDS, word_match), F.lit("quota"))
            .when(_mentions(low, fixed.PERMANENT_WORDS, word_match), F.lit("permanent"))
            .when(_mentions(low, fixed.RETRYABLE_WORDS, word_match), F.lit("retryable"))
            .otherwise(F.lit("other")))


def quota_label(message: Column) -> Column:
    low = F.lower(message)

    def holds(alternatives: list[list[str]]) -> Column:
        return reduce(or_, [reduce(and_, [F.contains(low, F.lit(w)) for w in words])
                            for words in alternatives])

    first, *rest = fixed.QUOTA_LABELS
    label = F.when(holds(first[1]), F.lit(first[0]))
    for name, alternatives in rest:
        label = label.when(holds(alternatives), F.lit(name))
    return label.otherwise(F.lit(fixed.QUOTA_DEFAULT_LABEL))


def quota_code(message: Column) -> Column:
    return F.when(F.contains(message, F.lit("429")), F.lit(429))


def permanent_code(message: Column) -> Column:
    """The first known status code found in the text, in list order."""
    return F.coalesce(*[F.when(F.contains(message, F.lit(str(code))), F.lit(code))
                        for code in fixed.PERMANENT_CODES])


def permanent_label(message: Column) -> Column:
    low = F.lower(message)
    return F.coalesce(*[F.when(F.contains(low, F.lit(label.lower())), F.lit(label))
                        for label in fixed.PERMANENT_LABELS])


def backoff_seconds(attempt: Column, base: int = fixed.BACKOFF_SECONDS,
                    retries: int = fixed.API_RETRIES) -> Column:
    """Wait before retry ``attempt`` (1-based); NULL once the retries are used up."""
    wait = F.lit(base) * F.pow(F.lit(2), attempt - 1)
    return F.when((attempt >= 1) & (attempt <= retries), wait.cast("bigint"))
