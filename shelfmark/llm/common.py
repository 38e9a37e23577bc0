"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.session import work_path

# A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
# carriage return; on UTF-8 bytes that is exactly what bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text as a long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows through a compressed table in the shared folder.

    Cuts lineage like a checkpoint at a fraction of its size, and tells the planner the size of the
    table, so a join sends a small one along and shuffles for a large one.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
