"""The product store: resume, insert-if-absent, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfmark import fixed_values as fixed
from shelfmark.functions.text import strip
from shelfmark.operators.buckets import BucketStore
from shelfmark.operators.series import at_most
from shelfmark.operators.sizing import BROADCAST_BYTES, join_sized
from shelfmark.session import checkpointed, saved
from shelfmark.sources import products as source


def done_urls(store: DataFrame) -> DataFrame:
    """URLs of stored products whose name is a real one."""
    name = F.lower(strip(F.coalesce(F.col("name"), F.lit(""))))
    return store.where(~name.isin(fixed.NOT_DONE_NAMES)).select("url")


def remaining(work: DataFrame, store: DataFrame, url: str = "url") -> DataFrame:
    """Work that is not in the store yet. Both sides shuffle on the URL alone;
    a URL with very many work rows is split by the skew join of AQE."""
    done = done_urls(store).withColumnRenamed("url", url)
    return work.join(done, url, "left_anti")


#: Random lines whose order keys cut the list into ranges, and lines of the border range that are sorted as a whole.
CUTS = 512
SORTED_LINES = 1 << 20


def limit_work(work: DataFrame, target: int, line: str = "line") -> DataFrame:
    """The first ``target`` lines in list order; 0 means all of them.

    Random lines cut the list into ranges. Ranges are counted; those in front of the border stay as they are,
    unsorted, and only the range that the border falls into is ranked, so no task merges the target.
    The result does not depend on the lines drawn. Rows are in list order only for target 0.
    """
    if target <= 0:
        return work.orderBy(F.lower(line), F.col(line))
    low = F.coalesce(F.lower(line), F.lit(""))
    key = F.concat(low, F.lit("\0"), F.coalesce(F.col(line), F.lit("")))  # sorts as (lower, line) does
    front, rest = None, saved(work, "work")
    while True:
        drawn = rest.select(key.alias("k"), F.rand(target).alias("r")).orderBy("r").limit(CUTS).select("k").collect()
        cuts = sorted({r.k for r in drawn})
        place = at_most(key, cuts)
        counts = dict(rest.groupBy(place.alias("p")).count().collect())
        before, border = 0, 0
        for border in sorted(counts):
            if before + counts[border] >= target:
                break
            before += counts[border]
        else:
            border += 1
        ahead = rest.where(place < border)
        front, target = ahead if front is None else front.union(ahead), target - before
        rest = rest.where(place == border)
        size = counts.get(border, 0)
        if size <= SORTED_LINES or len(counts) == 1:
            return front.union(rest.orderBy(F.lower(line), F.col(line)).limit(target))


def progress(work: DataFrame, store: DataFrame, url: str = "url") -> DataFrame:
    """total, filtered_out, remaining in one pass over the work list."""
    done = done_urls(store).distinct().select(F.col("url").alias(url), F.lit(True).alias("_done"))
    return work.join(done, url, "left").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_done").isNotNull()).alias("filtered_out"),
        F.count_if(F.col("_done").isNull()).alias("remaining"))


def first_per_url(df: DataFrame, seq: str, url: str = "url") -> DataFrame:
    """The row with the smallest ``seq`` of each URL; equal numbers are settled by a hash of the values.

    The rank is cut to one before the shuffle too, so a URL that comes very often sends one row a task.
    """
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    order = Window.partitionBy(url).orderBy(seq, F.xxhash64(*plain))
    return df.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")


def absent(new: DataFrame, store: DataFrame, seq: str, url: str = "url") -> DataFrame:
    """New rows to insert: first write wins, stored rows stay as they are."""
    return first_per_url(new, seq, url).join(store.select(url), url, "left_anti")


def drop_stored(pages: DataFrame, store: DataFrame, url: str = "url",
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pages whose URL a plain table lacks, found through the narrow URL column."""
    known = checkpointed(store.select(url).join(pages.select(url), url, "left_semi").distinct())
    return join_sized(pages, known, [url], "left_anti", broadcast_bytes=broadcast_bytes)


def keep_listed(pages: DataFrame, listed: DataFrame, url: str = "url",
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pages whose URL is on the list."""
    wanted = checkpointed(listed.select(url).distinct())
    return join_sized(pages, wanted, [url], "left_semi", broadcast_bytes=broadcast_bytes)


def open_store(spark: SparkSession, path: str, **options) -> BucketStore:
    """The product store at ``path``, in hash buckets; made there if it is new."""
    return BucketStore(spark, path, source.STORE, **options)


def insert_if_absent(new: DataFrame, path: str, seq: str, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Append the absent rows. Running it again with the same rows adds none.

    Only buckets that may hold one of the new URLs are opened. One writer per store: two at a time
    could both see a URL as absent.
    """
    held = open_store(new.sparkSession, path)
    # Settled on URL and number alone; whole rows are joined back only for URLs that are absent.
    first = saved(new.groupBy("url").agg(F.min(seq).alias(seq)), "first-rows")
    fresh = saved(held.drop_known(first, broadcast_bytes), "absent-rows")
    if not fresh.isEmpty():
        rows = first_per_url(join_sized(new, fresh, ["url", seq], "left_semi", broadcast_bytes=broadcast_bytes), seq)
        held.append(source.in_store_form(rows), fresh)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Rewrite a store of many small appends: a file per bucket, one bitmap per slot."""
    open_store(spark, path).compact(target)


def stored_count(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("products"))
