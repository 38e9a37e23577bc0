"""The product store and its JSON form."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfmark.schema import PRODUCT, PRODUCT_EXTRAS
from shelfmark.sources.json_arrays import parse_records, read_records

STORE = T.StructType(PRODUCT.fields + PRODUCT_EXTRAS.fields)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the store that ``operators.store`` keeps at ``path``; none before the first write.

    A store that is there but cannot be read fails the job: it must not be mistaken for an empty one.
    """
    try:
        return spark.read.schema(STORE).parquet(f"{path.rstrip('/')}/rows")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE)


def in_store_form(df: DataFrame) -> DataFrame:
    """The columns of the store in order, NULL where ``df`` has none."""
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in STORE))


def read_json(spark: SparkSession, path: str, *, layout: str = "array",
              strict: bool = True) -> DataFrame:
    """Products from JSON: one ``array`` per file, of any size, or ``lines``.

    ``strict`` fails on a broken record, as a write must; without it broken records are left out, as the
    resume step wants; ``broken_json`` returns and so counts them. Both layouts are read in parallel.
    """
    if layout not in ("array", "lines"):
        raise ValueError(f"unknown layout {layout!r}")
    if layout == "lines":
        return spark.read.schema(PRODUCT).options(mode="FAILFAST" if strict else "DROPMALFORMED").json(path)
    rows = _array_rows(spark, path)
    if not strict:
        rows = rows.where("_broken IS NULL")
    else:
        broken = F.raise_error(F.concat(F.lit("broken product record: "), F.left("_broken", F.lit(200))))
        rows = rows.withColumn("url", F.when(F.col("_broken").isNotNull(), broken.cast("string")).otherwise(F.col("url")))
    return rows.select(*PRODUCT.fieldNames())


def broken_json(spark: SparkSession, path: str) -> DataFrame:
    """file, number and text of the records of JSON arrays that ``read_json(strict=False)`` leaves out."""
    return _array_rows(spark, path).where("_broken IS NOT NULL").select("file", "number", F.col("_broken").alias("record"))


def _array_rows(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(read_records(spark, path), PRODUCT)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in contract order, text kept as it is."""
    df.select(*PRODUCT.fieldNames()).write.mode("errorifexists").json(path)

