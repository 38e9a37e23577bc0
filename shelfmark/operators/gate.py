"""Quality gate and price rules for product records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import fixed_values as fixed
from shelfmark.functions import money
from shelfmark.functions.text import strip


def _trimmed(column: str) -> Column:
    return strip(F.coalesce(F.col(column), F.lit("")))


def reject_reason() -> Column:
    """``invalid_name``, ``invalid_price`` or NULL for a record that passes."""
    return (F.when(_trimmed("name").isin(fixed.INVALID_NAMES), F.lit("invalid_name"))
            .when(_trimmed("current_price_integer").isin(fixed.INVALID_PRICES),
                  F.lit("invalid_price")))


def valid_products(df: DataFrame) -> DataFrame:
    return df.where(reject_reason().isNull())


def failed_pages(made: DataFrame, seq: str) -> DataFrame:
    """(url, seq, error) of the pages that could not be parsed."""
    return made.where(F.col("_error").isNotNull()).select("url", F.col(seq).alias("seq"),
                                                          F.col("_error").alias("error"))


def reason_counts(df: DataFrame) -> DataFrame:
    reason = F.coalesce(reject_reason(), F.lit("ok")).alias("reason")
    return df.groupBy(reason).agg(F.count("*").alias("products"))


def with_price_checks(df: DataFrame, old: str = "old_price", current: str = "current_price",
                      percent: str = "discount_pct") -> DataFrame:
    """Price consistency over decimal prices and a whole percent.

    Adds ``price_inverted``, the repaired pair, the percent that follows from
    it, ``discount_mismatch`` and ``show_discount`` (off for equal prices).
    """
    o, c = F.col(old), F.col(current)
    df = (df.withColumn("price_inverted", F.coalesce(o < c, F.lit(False)))
          .withColumn("fixed_old", F.when(o.isNotNull(), F.greatest(o, c)))
          .withColumn("fixed_current", F.least(o, c)))
    off = F.when(F.col("fixed_old") > 0, money.percent_off(
        F.col("fixed_old").cast("double"), F.col("fixed_current").cast("double")))
    return (df.withColumn("fixed_discount", off)
            .withColumn("discount_mismatch", F.coalesce(
                F.col(percent) != F.col("fixed_discount"), F.lit(False)))
            .withColumn("show_discount", F.coalesce(
                F.col("fixed_old") > F.col("fixed_current"), F.lit(False))))
