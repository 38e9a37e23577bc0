"""Streaming jobs, run over the test tables until all input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from shelfmark.catalogue import inputs as i, q_logs, q_products, render as r
from shelfmark.catalogue.registry import query
from shelfmark.session import work_path
from shelfmark.sources.products import read_store
from shelfmark.streaming import landing


@query("stream_products", f"""
    SELECT url, name, current_price_integer, old_price_integer, discount_percentage
    FROM ({q_products.RECORDS_SQL}) WHERE name <> 'Unknown Product' AND current_price_integer <> '0'""")
def stream_products(t):
    landed = work_path(t.spark, "landed")
    r.render_pages(t).write.parquet(landed)
    path = work_path(t.spark, "stream-store")
    pages = landing.read_landing(t.spark, landed)
    for _ in range(2):      # the second run resumes and finds nothing new
        landing.start_extract(pages, path, f"{path}-checkpoint").awaitTermination()
    return read_store(t.spark, path).select(
        "url", "name", "current_price_integer", "old_price_integer", "discount_percentage")


@query("pages_failed", "SELECT url, page_id AS seq, 'AssertionError' AS error FROM pages WHERE page_id % 7 = 3")
def pages_failed(t):
    """Pages whose markup the parser refuses, as the stream writes them aside; the others are stored."""
    landed = work_path(t.spark, "landed-broken")
    broken = F.when(F.col("page_id") % 7 == 3, "<![bad[x]]>").otherwise("")
    t.pages.select("page_id", "url", F.concat("html", broken).alias("html")).write.parquet(landed)
    path = work_path(t.spark, "failing-store")
    for _ in range(2):
        landing.start_extract(landing.read_landing(t.spark, landed), path, f"{path}-checkpoint", triage_pages=False,
                              failed_path=f"{path}-failed").awaitTermination()
    failed = t.spark.read.parquet(f"{path}-failed")
    return failed.select("url", "seq", F.substring_index("error", ":", 1).alias("error"))


@query("stream_saved", f"""
    SELECT url, name, 1::BIGINT AS seen FROM ({q_products.RECORDS_SQL})
    WHERE name <> 'Unknown Product' AND current_price_integer <> '0'""")
def stream_saved(t):
    """What the callback of the stream sees: every new row once, whatever is landed again."""
    landed = work_path(t.spark, "landed-twice")
    path = work_path(t.spark, "callback-store")

    def note(rows, batch_id):
        landing.write_batch(rows.select("url", "name"), f"{path}-seen", batch_id)
    for _ in range(2):      # the same pages land again in new files
        r.render_pages(t).write.mode("append").parquet(landed)
        landing.start_extract(landing.read_landing(t.spark, landed), path, f"{path}-checkpoint",
                              on_saved=note).awaitTermination()
    return t.spark.read.parquet(f"{path}-seen").groupBy("url", "name").agg(F.count("*").alias("seen"))


@query("stream_file_limit", "SELECT 3::BIGINT AS batches, 2::BIGINT AS most_files, count(*) AS orders FROM orders")
def stream_file_limit(t):
    """Six files in micro-batches of two."""
    landed, out = work_path(t.spark, "landed-orders"), work_path(t.spark, "file-limit")
    t.orders.select("o_orderkey").withColumn("part", F.col("o_orderkey") % 6).repartition(6, "part").write.partitionBy("part").parquet(landed)
    stream = landing.read_landing(t.spark, landed, T.StructType([T.StructField("o_orderkey", T.LongType())]), max_files=2)

    def count(rows, batch_id):
        landing.write_batch(rows.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("n")), out, batch_id)
    (stream.select(F.col("_metadata.file_path").alias("_file")).writeStream.foreachBatch(count)
     .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination())
    per = t.spark.read.parquet(out).groupBy("batch_id").agg(F.count("*").alias("files"), F.sum("n").alias("n"))
    return per.agg(F.count("*").alias("batches"), F.max("files").alias("most_files"), F.sum("n").alias("orders"))


_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())])


def _events(t):
    return landing.read_landing(t.spark, t.folder, _EVENT, pattern="events.parquet")


@query("stream_url_dedupe", f"SELECT DISTINCT url FROM ({i.ATTEMPTS_SQL})")
def stream_url_dedupe(t):
    out = work_path(t.spark, "stream-urls")
    urls = _events(t).select(F.format_string("https://site.example/p-%d.html", "user_id").alias("url"))
    landing.run_to_table(landing.distinct_urls(urls), out, f"{out}-checkpoint")
    return t.spark.read.parquet(out)


@query("stream_retry", q_logs.RETRY_SQL)
def stream_retry(t):
    out = work_path(t.spark, "stream-retry")
    attempts = _events(t).select(
        F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp"),
        F.format_string("https://site.example/p-%d.html", "user_id").alias("url"),
        (F.col("event_type") != "error").alias("ok"))
    landing.run_to_table(landing.retry_outcomes(attempts), out, f"{out}-checkpoint")
    return t.spark.read.parquet(out).select("attempt_id", "url", "retry_no", "outcome")
