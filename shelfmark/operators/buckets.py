"""A store in hash buckets with membership filters, so an insert opens only buckets it may meet.

Rows lie below ``rows/bucket=n`` by a hash of their URL. For every append ``filters`` gets one bitmap per
slot (a bucket has ``SLOTS`` of them): each URL sets ``PROBES`` bits of its slot. A batch of URLs meets
the bitmaps of its slots in one join on the slot; only the buckets of URLs that pass are read, and only
their URL column. A filter may name a bucket too many, never one too few, so the result is exact.

An append writes its bitmaps before its rows: a job that dies between the two leaves bits without
rows, which cost a look and change nothing. One writer per store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfmark.operators.sizing import BROADCAST_BYTES, join_sized

#: Fit for some million URLs; give a store of billions some thousand buckets.
BUCKETS = 8
#: Bitmaps per bucket. With three bits per URL one new URL in 120 passes a bitmap that holds 150.
SLOTS = 256
PROBES = 3
_BITS = 2048
#: Tasks that write the buckets of an append, at most, and rows of a bucket from which a second one helps.
WRITERS = 1000
SHARE_ROWS = 50_000
_LAYOUT = T.StructType([T.StructField("buckets", T.IntegerType()), T.StructField("slots", T.IntegerType())])


def _slot(url: Column, buckets: int, slots: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets * slots)).cast("int")


def _probes(url: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(url, F.lit(n)), F.lit(_BITS)) for n in range(PROBES)]


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1


class BucketStore:
    """Rows of ``schema`` below ``path``, once per URL."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, *, url: str = "url",
                 buckets: int = BUCKETS, slots: int = SLOTS):
        """``buckets`` and ``slots`` count for a new store; a store that is there keeps its own."""
        self.spark, self.path, self.schema, self.url = spark, path.rstrip("/"), schema, url
        found = self._table("layout", _LAYOUT)
        if found is not None:
            buckets, slots = found.head()
        else:
            spark.range(1, numPartitions=1).select(F.lit(buckets).alias("buckets"), F.lit(slots).alias("slots")).write.parquet(f"{self.path}/layout")
        self.buckets, self.slots = buckets, slots

    def _table(self, part: str, schema: T.StructType) -> DataFrame | None:
        """A part of the store; one that is there but cannot be read fails the job."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _rows(self) -> DataFrame | None:
        return self._table("rows", T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())]))

    def read(self) -> DataFrame:
        rows = self._rows()
        return self.spark.createDataFrame([], self.schema) if rows is None else rows.drop("bucket")

    def may_hold(self, urls: DataFrame) -> list[int]:
        """The buckets to be opened for ``urls(url)``: at most one number per bucket reaches the driver."""
        filters = self._table("filters", T.StructType([
            T.StructField("slot", T.IntegerType()), T.StructField("bitmap", T.BinaryType())]))
        if filters is None:
            return []
        url = F.col(self.url)
        asked = urls.select(_slot(url, self.buckets, self.slots).alias("slot"),
                            F.struct(*(p.alias(f"p{n}") for n, p in enumerate(_probes(url)))).alias("bits"))
        passed = asked.join(filters, "slot")
        for n in range(PROBES):
            passed = passed.where(_is_set(F.col("bitmap"), F.col(f"bits.p{n}")))
        found = passed.select(F.floor(F.col("slot") / self.slots).cast("int").alias("bucket")).distinct()
        return sorted(r.bucket for r in found.collect())

    def urls_of(self, buckets: list[int]) -> DataFrame | None:
        """The URL column of some buckets; the other buckets are not listed, let alone read."""
        rows = self._rows() if buckets else None
        if rows is None:
            return None
        if len(buckets) < self.buckets:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.select(self.url)

    def drop_known(self, df: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """The rows whose URL is not stored."""
        stored = self.urls_of(self.may_hold(df.select(self.url)))
        return df if stored is None else join_sized(df, stored, [self.url], "left_anti", broadcast_bytes=broadcast_bytes)

    def append(self, rows: DataFrame, urls: DataFrame | None = None) -> None:
        """Add rows whose URLs are known to be absent and distinct; ``urls`` are theirs, if they lie ready.

        Ready URLs are counted, and the buckets of a large append are written by several tasks each.
        """
        url, slot = F.col(self.url), _slot(F.col(self.url), self.buckets, self.slots)
        ((rows if urls is None else urls).select(slot.alias("slot"), F.explode(F.array(*_probes(url))).alias("bit"))
         .groupBy("slot").agg(F.substring(F.bitmap_construct_agg("bit"), 1, _BITS // 8).alias("bitmap"))
         .coalesce(1 + self.buckets * self.slots // (1 << 16)).write.mode("append").parquet(f"{self.path}/filters"))
        each = 1 if urls is None else max(1, min(urls.count() // SHARE_ROWS, WRITERS) // self.buckets)
        dealt = ["bucket"] if each == 1 else ["bucket", F.pmod(F.xxhash64(url, F.lit("share")), F.lit(each))]
        (rows.select(*self.schema.fieldNames(), F.floor(slot / self.slots).cast("int").alias("bucket"))
         .repartition(min(self.buckets * each, WRITERS), *dealt)
         .write.mode("append").partitionBy("bucket").parquet(f"{self.path}/rows"))

    def compact(self, target: str) -> BucketStore:
        """The same store below ``target``: one bitmap per slot, the files of a bucket in one."""
        fresh = BucketStore(self.spark, target, self.schema, url=self.url, buckets=self.buckets, slots=self.slots)
        fresh.append(self.read())
        return fresh
