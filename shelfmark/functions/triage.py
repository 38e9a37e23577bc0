"""Page triage: block page, login page, product page or something else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import fixed_values as fixed
from shelfmark.functions.text import contains_any, count_found


def _lowered(words: list[str]) -> list[str]:
    return [w.lower() for w in words]


def url_blocked(url: Column, patterns: list[str] = fixed.URL_BLOCK_PATTERNS) -> Column:
    return F.coalesce(contains_any(F.lower(url), _lowered(patterns)), F.lit(False))


def text_blocked(low: Column, words: list[str] = fixed.TEXT_BLOCK_WORDS) -> Column:
    """``low`` is page text that is already in lower case."""
    return F.coalesce(contains_any(low, _lowered(words)), F.lit(False))


def looks_like_product(low: Column, markers: list[str] = fixed.PRODUCT_MARKERS,
                       minimum: int = fixed.PRODUCT_MARKER_MINIMUM) -> Column:
    return F.coalesce(count_found(low, markers) >= minimum, F.lit(False))


def page_kind(url: Column, low: Column, *,
              url_patterns: list[str] = fixed.URL_BLOCK_PATTERNS,
              text_words: list[str] = fixed.TEXT_BLOCK_WORDS,
              markers: list[str] = fixed.PRODUCT_MARKERS,
              minimum: int = fixed.PRODUCT_MARKER_MINIMUM,
              login_path: str = fixed.LOGIN_PATH) -> Column:
    """``blocked`` (by URL), ``login``, ``product``, ``blocked`` (by text) or ``other``."""
    blocked_text = text_blocked(low, text_words)
    return (F.when(url_blocked(url, url_patterns), F.lit("blocked"))
            .when(F.contains(F.lower(url), F.lit(login_path)), F.lit("login"))
            .when(blocked_text, F.lit("blocked"))
            .when(looks_like_product(low, markers, minimum), F.lit("product"))
            .otherwise(F.lit("other")))


def product_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The pages whose kind is ``product``, with the same columns."""
    # a lambda, as a column would be put in for each of the words: every one would lower the whole page again
    kind = F.transform(F.array(F.lower(html)), lambda low: page_kind(F.col(url), low))[0]
    return pages.where(kind == "product")
