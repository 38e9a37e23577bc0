"""Operational log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.operators.oplog import parse_lines


_ROW_BITS = 33


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines with file, block and row: their place, which grows along each file.

    ``oplog.with_dates(df, day, ["block", "row"], ["file"])`` dates them.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    lines = (spark.read.text(path).withColumnRenamed("value", "line")
             .withColumn("file", F.col("_metadata.file_path"))
             .withColumn("block", F.col("_metadata.file_block_start")).withColumn("row", row))
    return parse_lines(lines.where(F.col("line") != ""))
