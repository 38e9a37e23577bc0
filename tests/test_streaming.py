"""Streams end in the tables that batch jobs make."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import gate, oplog, products
from shelfmark.sources.products import read_store
from shelfmark.streaming import landing

PAGE = '<h1>%s</h1><div id="productMainPriceId">$%d.00</div>'


def test_extract_stream_resumes(spark, tmp_path):
    landed, path = str(tmp_path / "landed"), str(tmp_path / "store")
    rows = [(n, f"u{n % 7}", PAGE % (f"thing {n}", n)) for n in range(1, 13)] + [(20, "bad", "<p>")]
    seen = []

    def land(part):
        spark.createDataFrame(part, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(landed)

    def run():
        pages = landing.read_landing(spark, landed, max_files=1)
        landing.start_extract(pages, path, str(tmp_path / "cp"),
                              on_saved=lambda df, n: seen.append(df.count())).awaitTermination()
    land(rows[:5])
    run()
    land(rows[5:])
    run()
    run()
    got = {(r["url"], r["name"]) for r in read_store(spark, path).collect()}
    assert got == {(f"u{n % 7}", f"Thing {n}") for n in range(1, 8)}
    assert seen == [5, 2]
    batch = spark.createDataFrame(rows, "page_id long, url string, html string").where("page_id <= 7")
    want = gate.valid_products(products.extract_products(batch))
    columns = ["url", "name", "current_price", "description"]
    assert sorted(map(tuple, read_store(spark, path).select(columns).collect())) == sorted(
        map(tuple, want.select(columns).collect()))


def test_distinct_urls_across_batches(spark, tmp_path):
    landed = str(tmp_path / "urls")
    schema = "url string, ts timestamp"
    for part in (["a", "b", "a"], ["b", "c"]):
        rows = spark.createDataFrame([(u,) for u in part], "url string").withColumn(
            "ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(landed)
    for n, within in enumerate((None, "1 day")):
        stream = landing.read_landing(spark, landed, rows.schema, max_files=1)
        out = str(tmp_path / f"out{n}")
        landing.run_to_table(landing.distinct_urls(stream, within), out, out + "-cp")
        assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"], schema


def test_retry_state_equals_batch(spark, tmp_path):
    landed = str(tmp_path / "attempts")
    schema = "attempt_id long, ts timestamp, url string, worker long, ok boolean"
    rows = spark.range(0, 60).select(
        F.col("id").alias("attempt_id"), F.timestamp_seconds(F.col("id")).alias("ts"),
        F.concat(F.lit("u"), (F.col("id") % 4).cast("string")).alias("url"),
        (F.col("id") % 3).alias("worker"), (F.col("id") % 5 == 0).alias("ok"))
    for low in (0, 20, 40):
        rows.where((F.col("attempt_id") >= low) & (F.col("attempt_id") < low + 20)).coalesce(1).write.mode(
            "append").parquet(landed)
    files = spark.read.parquet(landed)
    stream = landing.read_landing(spark, landed, files.schema, max_files=1)
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")     # groups in several parts
    landing.run_to_table(landing.retry_outcomes(stream), out, out + "-cp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    columns = ["attempt_id", "retry_no", "outcome"]
    got = {tuple(r) for r in spark.read.parquet(out).select(columns).collect()}
    assert got == {tuple(r) for r in oplog.retry_outcomes(files).select(columns).collect()}, schema


def test_a_batch_that_runs_again_replaces_its_failures(spark, tmp_path):
    """The job dies between the side output and the store; the batch is run again."""
    landed, path = str(tmp_path / "landed"), str(tmp_path / "store")
    rows = [(n, f"u{n}", PAGE % (f"thing {n}", n)) for n in range(1, 5)] + [(9, "bad", "<![bad[x]]>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(landed)

    def run(on_saved):
        pages = landing.read_landing(spark, landed)
        landing.start_extract(pages, path, str(tmp_path / "cp"), failed_path=f"{path}-failed", triage_pages=False,
                              on_saved=on_saved).awaitTermination()

    def die(df, batch_id):
        raise RuntimeError("lost")
    with pytest.raises(Exception):
        run(die)
    assert spark.read.parquet(f"{path}-failed").count() == 1 and read_store(spark, path).count() == 0
    run(lambda df, batch_id: None)
    failed = spark.read.parquet(f"{path}-failed").collect()
    assert [(r["url"], r["seq"]) for r in failed] == [("bad", 9)] and failed[0]["error"].startswith("AssertionError")
    assert read_store(spark, path).count() == 4


def test_a_batch_is_parsed_and_ranked_once(spark, tmp_path, monkeypatch):
    landed = str(tmp_path / "landed")
    rows = [(n, f"u{n}", PAGE % ("thing", n)) for n in range(1, 4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(landed)
    plans = []
    landing.start_extract(landing.read_landing(spark, landed), str(tmp_path / "store"), str(tmp_path / "cp"), on_saved=lambda df, n: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString())).awaitTermination()
    assert len(plans) == 1 and "Window" not in plans[0] and "MapInArrow" not in plans[0]
    assert read_store(spark, str(tmp_path / "store")).count() == 3
