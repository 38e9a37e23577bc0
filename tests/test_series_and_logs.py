"""Chunked series against plain windows; logs; plans."""

from __future__ import annotations

import random

from pyspark.sql import Window, functions as F

import __spark_entry__ as entry
from shelfmark import catalogue
from shelfmark.catalogue import inputs
from shelfmark.catalogue.registry import Tables
from shelfmark.operators import oplog, series

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark):
    """One key holds most rows and spans many chunks, some with no row."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), n * rng.choice([1, 1, 1, 3]), n, rng.randrange(5))
            for n in range(3000)] + [(k, None, 5000 + n, n) for n, k in enumerate(["hot", "hot", "a", None])]
    return spark.createDataFrame(rows, "k string, pos long, id long, v long").withColumn(
        "c", series.range_chunk("pos", 64))


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_running_equals_window(spark):
    df = hot_rows(spark)
    w = Window.partitionBy("k").orderBy("pos", "id")
    for before, end in ((False, 0), (True, -1)):
        frame = w.rowsBetween(Window.unboundedPreceding, end)
        got = series.running(df, ["k"], "c", ["pos", "id"], sums={"s": F.col("v")},
                             maxes={"m": F.when(F.col("v") == 4, F.col("pos"))},
                             before=before)
        want = df.withColumn("s", F.coalesce(F.sum("v").over(frame), F.lit(0))).withColumn(
            "m", F.max(F.when(F.col("v") == 4, F.col("pos"))).over(frame))
        same(got.select("k", "id", "s", "m"), want.select("k", "id", "s", "m"))


def test_running_without_keys(spark):
    df = hot_rows(spark)
    got = series.running(df, [], "c", ["pos", "id"], sums={"s": F.col("v")})
    want = df.withColumn("s", F.sum("v").over(Window.orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, 0)))
    same(got.select("id", "s"), want.select("id", "s"))


def test_neighbours_equal_lag_and_lead(spark):
    df = hot_rows(spark).withColumn("x", F.nullif("v", F.lit(2)))
    w = Window.partitionBy("k").orderBy("pos", "id")
    want = df.withColumn("p", F.lag("x").over(w)).withColumn("n", F.lead("x").over(w))
    got = series.neighbours(df, ["k"], "c", ["pos", "id"], previous={"p": "x"}, following={"n": "x"})
    same(got.select("k", "id", "p", "n"), want.select("k", "id", "p", "n"))


def test_since_last_equals_walk(spark):
    df = hot_rows(spark)
    got = {r["id"]: r["n"] for r in series.since_last(
        df, ["k"], "c", ["pos", "id"], reset=F.col("v") == 0, name="n").collect()}
    count = {}
    for r in sorted(df.collect(), key=lambda r: (-1 if r["pos"] is None else r["pos"], r["id"])):
        count[r["k"]] = 0 if r["v"] == 0 else count.get(r["k"], 0) + 1
        assert got[r["id"]] == count[r["k"]]


def test_states_without_time_come_first(spark):
    rows = [("w", None, 1, "A"), ("w", 10, 2, "B"), ("w", 7200, 3, "C"), (None, 5, 4, "A"), (None, 9999, 5, "B")]
    states = spark.createDataFrame(rows, "worker string, s long, id long, status string").withColumn(
        "ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {(r["worker"], r["old_status"], r["new_status"]) for r in oplog.transitions(states).collect()}
    assert got == {("w", "?", "A"), ("w", "A", "B"), ("w", "B", "C"), (None, "?", "A"), (None, "A", "B")}


LOG = "\x1b[92m12:00:01 [Browser-1] [SCRAPING] [AVAILABLE→SCRAPING] https://s.example/a-p-1.html\x1b[0m"


def test_log_lines(spark):
    rows = [(1, LOG), (2, "\x1b[91m11:00:00 [BROWSER_POOL] Discarding x\x1b[0m"),
            (3, "\x1b[93m11:00:05 [Browser-2] [BLOCKED] [BLOCKED→AVAILABLE]\x1b[0m"), (4, "no log line")]
    parsed = oplog.parse_lines(spark.createDataFrame(rows, "pos long, line string"))
    got = {r["pos"]: (r["log_time"], r["worker"], r["status"], r["level"], r["old_status"], r["new_status"], r["url"])
           for r in parsed.collect()}
    assert got[1] == ("12:00:01", "Browser-1", "SCRAPING", "INFO", "AVAILABLE", "SCRAPING", "https://s.example/a-p-1.html")
    assert got[2] == ("11:00:00", "BROWSER_POOL", None, "ERROR", None, None, None)
    assert got[3] == ("11:00:05", "Browser-2", "BLOCKED", "WARNING", "BLOCKED", "AVAILABLE", None)
    assert got[4] == (None,) * 7
    dated = oplog.with_dates(parsed, "2024-02-28").orderBy("pos")
    assert [str(r["ts"]) for r in dated.collect()] == [
        "2024-02-28 12:00:01", "2024-02-29 11:00:00", "2024-02-29 11:00:05"]


def test_snapshot_cooldown(spark):
    rows = [(1, "2024-01-01 00:00:00", "AVAILABLE"), (1, "2024-01-01 00:01:00", "BLOCKED"),
            (2, "2024-01-01 00:02:30.5", "AVAILABLE"), (3, "2023-12-31 00:00:00", "BLOCKED")]
    states = spark.createDataFrame([(w, t, s, n) for n, (w, t, s) in enumerate(rows)],
                                   "worker long, t string, status string, id long")
    states = states.withColumn("ts", F.to_timestamp_ntz("t"))
    got = {r["worker"]: (r["status"], r["cooldown_s"]) for r in oplog.snapshot(states).collect()}
    assert got == {1: ("BLOCKED", 89), 2: ("AVAILABLE", 0), 3: ("BLOCKED", 0)}


def test_plans_hold_at_scale(spark):
    """No cross joins; hot groups are cut or combined before they are shuffled."""
    eager = ("stream_", "discovery", "url_list_", "log_scan", "products_upsert", "products_count", "products_read")
    lazy = [n for n in catalogue.QUERIES if not n.startswith(eager)]
    plans = {n: plan(entry.queries()[n](spark, FOLDER)) for n in lazy}
    for name, text in plans.items():
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name
        assert "BatchEvalPython" not in text, name
    assert "WindowGroupLimit" in plans["retry_outcome"]
    assert "TakeOrderedAndProject" in plans["resume_limit"]
    assert plans["links_first_seen"].count("partial_min") == 1
    assert "SortAggregate" not in plans["links_first_seen"]
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" not in plans["status_dwell"]
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plans["url_canon"]
    assert "MapInArrow" in plans["products_extract"]


def test_even_chunks_of_crowded_times(spark):
    """All rows in one hour, a third of them in one instant: chunks stay even and in order."""
    n = F.col("id")
    rows = spark.range(30_000).select(
        F.when(n % 3 == 0, F.lit(1_800_000_000)).otherwise(F.lit(1_800_000_000) + (n * 7919) % 3600 - 1800)
        .cast("timestamp").alias("ts"), "id", F.lit("w").alias("worker"), (n % 5).cast("string").alias("status"))
    cut = series.even_chunk(rows, ["ts", "id"], parts=16)
    sizes = [r["count"] for r in cut.groupBy("_chunk").count().collect()]
    assert max(sizes) <= 2 * 30_000 / 16 and sum(sizes) == 30_000
    ordered = [r["_chunk"] for r in cut.orderBy("ts", "id").select("_chunk").collect()]
    assert ordered == sorted(ordered)
    window = Window.partitionBy("worker").orderBy("ts", "id")
    want = {(r.id, r.was) for r in rows.select("id", F.lag("status").over(window).alias("was")).collect()}
    got = series.neighbours(cut, ["worker"], "_chunk", ["ts", "id"], previous={"was": "status"})
    assert {(r.id, r.was) for r in got.collect()} == want
    many = series.even_chunk(rows, ["ts", "id"], parts=200)
    assert [r["_chunk"] for r in many.orderBy("ts", "id").select("_chunk").collect()] == sorted(
        r["_chunk"] for r in many.select("_chunk").collect())
    empty = series.even_chunk(rows.limit(0), ["ts", "id"])
    assert series.running(empty, [], "_chunk", ["ts", "id"], sums={"n": F.col("id")}).count() == 0
