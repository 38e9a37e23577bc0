"""URL lists: preprocessing, the two cleaners, ordering, local-file join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions import urls
from shelfmark.functions.text import strip


def trim_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Trimmed lines, blank ones dropped."""
    return df.withColumn(line, strip(F.col(line))).where(F.col(line) != "")


def drop_comments(df: DataFrame, line: str = "line") -> DataFrame:
    return df.where(~urls.is_comment(F.col(line)))


def drop_dashes(df: DataFrame, line: str = "line") -> DataFrame:
    return df.withColumn(line, urls.drop_dash(F.col(line)))


def sort_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """By lower-case URL; the whole line settles ties."""
    return df.orderBy(urls.sort_key(F.col(line)), F.col(line))


def preprocess(df: DataFrame, line: str = "line") -> DataFrame:
    """Trim, drop comments, then remove list markers. Duplicates stay.

    A comment behind a marker (``- # x``) survives: comments go first.
    """
    return drop_dashes(drop_comments(trim_lines(df, line), line), line)


def clean_distinct(df: DataFrame, line: str = "line") -> DataFrame:
    """Canonical distinct URLs; list markers stay part of the line."""
    kept = drop_comments(trim_lines(df, line), line)
    return kept.select(urls.canonical(F.col(line)).alias("url")).distinct()


def clean_ordered(df: DataFrame, line: str = "line", pos: str = "pos") -> DataFrame:
    """Preprocessed distinct whole lines with the position of the first one."""
    return preprocess(df, line).groupBy(line).agg(F.min(pos).alias(pos))


def clean_recommended(df: DataFrame, line: str = "line") -> DataFrame:
    """Both cleaners' rules together: markers off, canonical, distinct."""
    kept = preprocess(df, line)
    return kept.select(urls.canonical(urls.list_url(F.col(line))).alias("url")).distinct()


def split_lines(df: DataFrame, line: str = "line") -> DataFrame:
    return (df.withColumn("url", urls.list_url(F.col(line)))
            .withColumn("local_path", urls.list_path(F.col(line))))


def with_local_html(lines: DataFrame, files: DataFrame,
                    take: dict[str, Column] | None = None) -> DataFrame:
    """Lines with the page text of their local file; ``files`` has (path, html).

    ``take`` names what is wanted of a page instead of its text; it is worked
    out before the join, so the text itself is not shuffled.

    Lines without a path keep NULL and never travel to the join, so the NULL
    key does not gather them in one task.
    """
    named = lines.where(F.col("local_path").isNotNull())
    plain = lines.where(F.col("local_path").isNull())
    take = take or {"html": F.col("html")}
    page = files.select(F.col("path").alias("local_path"), *(c.alias(n) for n, c in take.items()))
    for name in take:
        plain = plain.withColumn(name, F.lit(None).cast(page.schema[name].dataType))
    return (named.join(page, "local_path", "left").select(*lines.columns, *take)
            .unionByName(plain))


def page_urls(categories: DataFrame, last_page: int | str, url: str = "url") -> DataFrame:
    """One row per category page 1..last_page (a number or a column name)."""
    last = F.lit(last_page) if isinstance(last_page, int) else F.col(last_page)
    numbered = categories.withColumn("page_num", F.explode(F.sequence(F.lit(1), last.cast("int"))))
    return numbered.withColumn("page_url", urls.page_url(F.col(url), F.col("page_num")))
