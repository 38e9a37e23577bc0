"""Landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_pages(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet pages; only the columns a job selects are read.

    Parsing is CPU work, so an input of fewer splits than cores is spread over
    the cores. A large input has more splits than that and is never moved.
    """
    return spread(spark.read.parquet(path).select(*columns or ["*"]))


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a file scan that would leave cores idle; else unchanged."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """path, html: one row per HTML file below ``path``."""
    return (spark.read.text(path, wholetext=True, recursiveFileLookup=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")))


def land_bucketed(pages: DataFrame, table: str, buckets: int, path: str) -> None:
    """Write pages as a table bucketed by URL.

    Joins of such a table with a long URL list move the list, not the pages:
    choose at least as many buckets as shuffle partitions.
    """
    (pages.repartition(buckets, "url").write.mode("errorifexists").option("path", path)
     .bucketBy(buckets, "url").sortBy("url").saveAsTable(table))
