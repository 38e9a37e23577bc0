"""The category dimension."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from shelfmark import fixed_values as fixed

CATEGORY = T.StructType([
    T.StructField("category_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
])


def category_dim(spark: SparkSession, origin: str, path: str | None = None) -> DataFrame:
    """category_id, name, url; the built-in list on ``origin`` or a CSV of one's own."""
    if path is not None:
        return spark.read.schema(CATEGORY).csv(path, header=True)
    # an Arrow table becomes a local relation, whose size the planner knows
    ids, names, paths = zip(*fixed.CATEGORIES)
    table = pa.table({"category_id": pa.array(ids, pa.int32()), "name": list(names),
                      "url": [origin + path for path in paths]})
    return spark.createDataFrame(table)
