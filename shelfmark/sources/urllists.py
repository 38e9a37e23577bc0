"""URL list files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark import fixed_values as fixed
from shelfmark.functions import urls
from shelfmark.operators.urllists import drop_comments, trim_lines

_ROW_BITS = 33


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, line: trimmed lines that are not blank, in file order.

    ``pos`` packs the start of the file block and the row within its task, so
    it grows along each file without counting lines anywhere.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    raw = (spark.read.text(path).withColumnRenamed("value", "line")
           .withColumn("pos", F.struct(F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_block_start").alias("block"),
                                       row.alias("row"))))
    return trim_lines(raw).select("pos", "line")


def read_lines_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """None when there is no such list yet."""
    try:
        return read_lines(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_seed(spark: SparkSession, path: str) -> DataFrame | None:
    """Distinct canonical URLs of an earlier run; None when there was none."""
    lines = read_lines_or_none(spark, path)
    return None if lines is None else seed_urls(lines)


def seed_urls(lines: DataFrame) -> DataFrame:
    kept = drop_comments(trim_lines(lines))
    return kept.select(urls.canonical(F.col("line")).alias("url")).distinct()


def write_list(df: DataFrame, path: str, *, url: str = "url", local_path: str | None = None,
               header: str | None = None, backup: bool = True) -> None:
    """Lines ``url`` or ``url path`` in case-insensitive order, plus a backup copy.

    The sort is a range partitioning: part files in name order are the list,
    and no task holds more than its range.
    """
    line = F.col(url) if local_path is None else F.concat_ws(" ", F.col(url), F.col(local_path))
    rows = df.select(F.lit(1).alias("_rank"), F.lower(url).alias("_key"), line.alias("value"))
    if header is not None:
        top = df.sparkSession.range(1).select(
            F.lit(0).alias("_rank"), F.lit("").alias("_key"), F.lit(header).alias("value"))
        rows = rows.union(top)
    ordered = rows.orderBy("_rank", "_key", "value").select("value")
    targets = [path, f"{path.rstrip('/')}-backup"] if backup else [path]
    for target in targets:
        ordered.write.mode("overwrite").text(target)


def write_clean_list(df: DataFrame, path: str) -> None:
    """The cleaned list with its header comment."""
    write_list(df, path, header=fixed.LIST_HEADER, backup=False)


def append_found(df: DataFrame, path: str) -> None:
    """Append newly found URLs to a list folder."""
    df.select(F.col("url").alias("value")).write.mode("append").text(path)
