"""Column contracts shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

PRODUCT = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("product_name_safe", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("reviews", T.StringType()),
    T.StructField("available_sizes", T.ArrayType(T.StringType())),
    T.StructField("current_price_integer", T.StringType()),
    T.StructField("current_price_decimal", T.StringType()),
    T.StructField("old_price_integer", T.StringType()),
    T.StructField("old_price_decimal", T.StringType()),
    T.StructField("discount_percentage", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("description_structured", T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ])),
    T.StructField("is_international", T.BooleanType()),
])

# Typed and uncut companions of the text columns; NULL where the text holds a sentinel.
PRODUCT_EXTRAS = T.StructType([
    T.StructField("current_price", T.DecimalType(18, 2)),
    T.StructField("old_price", T.DecimalType(18, 2)),
    T.StructField("discount_pct", T.IntegerType()),
    T.StructField("shipping_status", T.StringType()),
    T.StructField("name_whole", T.StringType()),
    T.StructField("reviews_whole", T.StringType()),
])

PRODUCT_COLUMNS = PRODUCT.fieldNames()
EXTRA_COLUMNS = PRODUCT_EXTRAS.fieldNames()

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

ATTEMPTS = T.StructType([
    T.StructField("attempt_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("url", T.StringType()),
    T.StructField("worker", T.LongType()),
    T.StructField("ok", T.BooleanType()),
])
