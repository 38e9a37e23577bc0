"""Large JSON arrays, read in parallel wherever their line ends are, or without any.

A file that is one JSON array has no record separator that a reader could look for: braces and commas also
stand inside strings and inner objects. So the file is read as pieces that end in ``}``, which Spark's text
source can begin at any byte offset. What a piece does to the state is known without the pieces before:

* whether it has an odd number of quotes, that is, leaves a string open or closes one;
* the change of depth it makes if it begins outside a string, and if it begins inside one.

A running sum over the pieces in file order settles first which of both holds, then the depth, then the
number of the record. The sums are chunked (``operators.series``), so one large file is many tasks. The
pieces of a record are put together again; no task holds more than a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfmark.operators.series import range_chunk, running

_ROW_BITS = 33
#: A string and what is left of one: JSON escapes are a backslash and one character, at least.
_STRING = r'"(?:[^"\\]|\\.)*+"'
_OPEN_STRING = r'(?s)"(?:[^"\\]|\\.)*+\z'
_REST_OF_STRING = r'(?s)\A(?:[^"\\]|\\.)*+(?:"|\z)'


def _depth(piece: Column) -> Column:
    """Brackets opened less brackets closed in a piece that begins outside strings; its final ``}`` not counted."""
    bare = F.regexp_replace(F.regexp_replace(piece, "(?s)" + _STRING, ""), _OPEN_STRING, "")
    opened = F.length(bare) - F.length(F.translate(bare, "[{", ""))
    return (opened - (F.length(bare) - F.length(F.translate(bare, "]}", "")))).cast("bigint")


def _quotes(piece: Column) -> Column:
    bare = F.regexp_replace(piece, r"(?s)\\.", "")
    return (F.length(bare) - F.length(F.translate(bare, '"', ""))).cast("bigint")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, size, block, row, piece: the text between the ``}`` of each file, in order."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (spark.read.option("lineSep", "}").text(path).withColumnRenamed("value", "piece")
            .withColumn("file", F.col("_metadata.file_path")).withColumn("size", F.col("_metadata.file_size"))
            .withColumn("block", F.col("_metadata.file_block_start")).withColumn("row", row))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, number, record, whole: the JSON text of every top-level object, numbered within its file.

    ``whole`` is false for a last record that the end of the file cuts off. Numbers, strings and lists that
    stand between the objects are left out.
    """
    order = ["block", "row"]
    state = (_pieces(spark, path).withColumn("_chunk", F.struct("block", range_chunk("row").alias("range")))
             .withColumn("_quotes", _quotes(F.col("piece")))
             .withColumn("_outside", _depth(F.col("piece")))
             .withColumn("_inside", _depth(F.regexp_replace("piece", _REST_OF_STRING, "")))
             .withColumn("_blank", ~F.rlike("piece", F.lit(r"[^\s,\[\]]"))))
    bytes_ = (F.octet_length("piece") + 1).cast("bigint")
    state = running(state, ["file"], "_chunk", order, sums={"_before": F.col("_quotes"), "_at": bytes_}, before=True)
    inside = F.col("_before") % 2 == 1
    ends_inside = (F.col("_before") + F.col("_quotes")) % 2 == 1
    state = (state.withColumn("_change", F.when(inside, F.col("_inside")).otherwise(F.col("_outside")))
             # Its } is a bracket, and the file goes on that far: the last piece may have none.
             .withColumn("_closes", ~ends_inside & (F.col("_at") + bytes_ <= F.col("size"))))
    state = running(state, ["file"], "_chunk", order, sums={"_depth": F.col("_change") - F.col("_closes").cast("bigint")})
    # Depth 1 is inside the array: a } that leads there ends a record.
    state = state.withColumn("_ends", (F.col("_closes") & (F.col("_depth") == 1)).cast("bigint"))
    state = running(state, ["file"], "_chunk", order, sums={"number": F.col("_ends")}, before=True)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "piece"))), lambda p: p["piece"]), "}")
    records = state.groupBy("file", "number").agg(
        text.alias("record"), (F.max("_ends") == 1).alias("whole"), F.min("_blank").alias("_blank"))
    return (records.where(F.col("whole") | ~F.col("_blank"))
            .select("file", "number", F.regexp_replace(F.when(F.col("whole"), F.concat("record", F.lit("}"))).otherwise(
                F.col("record")), r"\A[\s,\[]+", "").alias("record"), "whole"))


def parse_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The records by a schema, and ``_broken`` with the text of those that are no JSON object of it."""
    mark = "_broken"
    wide = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), T.StructField(mark, T.StringType())])
    parsed = F.from_json("record", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": mark})
    return records.select("file", "number", "whole", F.when(F.col("whole"), parsed).alias("p"), "record").select(
        "file", "number", *(F.col(f"p.{f.name}").alias(f.name) for f in schema),
        F.when(~F.col("whole"), F.col("record")).otherwise(F.col(f"p.{mark}")).alias(mark))
