"""Operational logs as tables: parse, states, dwell, retries, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark import fixed_values as fixed
from shelfmark.functions.text import blank_to_null
from shelfmark.operators.series import even_chunk, neighbours, range_chunk, running

_ANSI = r"\x1B\[[0-9;]*[a-zA-Z]"
_LINE = r"^(\d{2}:\d{2}:\d{2}) \[([^\]]+)\](?: \[([A-Z_]+)\])? (.*)$"
_MOVE = r"^\[([^\]→]*)→([^\]]*)\](?: (.*))?$"
DAY_SECONDS = 86400


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, _ANSI, "")


def colour_level(c: Column) -> Column:
    """The level, which only the first colour code of a raw line tells."""
    code = F.regexp_extract(c, r"\x1B\[([0-9]+)m", 1)
    level = F.when(code == fixed.LEVEL_BY_COLOUR[0][0], fixed.LEVEL_BY_COLOUR[0][1])
    for value, name in fixed.LEVEL_BY_COLOUR[1:]:
        level = level.when(code == value, name)
    return level


def _groups(c: Column, pattern: str, count: int) -> Column:
    """The groups of one match as an array; a single element without a match."""
    marks = "\x01".join(f"${n}" for n in range(1, count + 1))
    return F.split(F.regexp_replace(c, pattern, marks), "\x01")


def parse_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """time, worker, status, level, message and, for moves, old / new / url.

    Each pattern runs once per line and yields all its groups.
    """
    def part(groups: str, n: int, count: int) -> Column:
        return F.when(F.size(groups) == count, blank_to_null(F.get(groups, F.lit(n))))
    df = (df.withColumn("level", colour_level(F.col(line)))
          .withColumn("_line", _groups(strip_ansi(F.col(line)), _LINE, 4)))
    for n, name in enumerate(("log_time", "worker", "status", "message")):
        df = df.withColumn(name, part("_line", n, 4))
    df = df.withColumn("_move", _groups(F.col("message"), _MOVE, 3))
    for n, name in enumerate(("old_status", "new_status", "url")):
        df = df.withColumn(name, part("_move", n, 3))
    return df.drop("_line", "_move")


def seconds_of_day(log_time: Column) -> Column:
    parts = F.split(log_time, ":")
    return (F.get(parts, F.lit(0)).cast("bigint") * 3600 + F.get(parts, F.lit(1)).cast("bigint") * 60
            + F.get(parts, F.lit(2)).cast("bigint"))


def with_dates(df: DataFrame, first_day: str | Column, position: str | list[str] = "pos",
               by: list[str] | None = None) -> DataFrame:
    """Adds ``ts`` to parsed lines: the time of day starts over at each new day.

    Lines are taken in the order of ``position`` within each value of ``by``, for
    files as ``read_log`` gives them ``["block", "row"]`` and ``["file"]``.
    ``first_day`` is a date, or a column of dates if the files start on different days.
    """
    order, keys = [position] if isinstance(position, str) else position, by or []
    chunk = F.struct(*order[:-1], range_chunk(order[-1]).alias("range"))
    df = (df.where(F.col("log_time").isNotNull())
          .withColumn("_second", seconds_of_day(F.col("log_time"))).withColumn("_chunk", chunk))
    df = neighbours(df, keys, "_chunk", order, previous={"_earlier": "_second"})
    df = running(df, keys, "_chunk", order,
                 sums={"_day": F.coalesce(F.col("_second") < F.col("_earlier"), F.lit(False)).cast("int")})
    start = (F.lit(first_day) if isinstance(first_day, str) else first_day).cast("date")
    day = F.date_add(start, F.col("_day").cast("int")).cast("timestamp_ntz")
    return (df.withColumn("ts", day + F.make_dt_interval(secs=F.col("_second").cast("decimal(18,6)")))
            .drop("_second", "_earlier", "_day", "_chunk"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    whole = F.hour(ts) * 3600 + F.minute(ts) * 60
    seconds = F.date_part(F.lit("SECOND"), ts)
    return ((days * DAY_SECONDS + whole) * 1000000 + (seconds * 1000000).cast("bigint")).cast("bigint")


def transitions(states: DataFrame) -> DataFrame:
    """old_status -> status per worker; the first state comes from ``?``.

    ``states`` has worker, ts, id, status. Workers are cut into chunks of equal
    numbers of rows.
    """
    cut = even_chunk(states, ["ts", "id"])
    out = neighbours(cut, ["worker"], "_chunk", ["ts", "id"], previous={"old_status": "status"})
    return (out.withColumn("old_status", F.coalesce("old_status", F.lit("?")))
            .withColumnRenamed("status", "new_status").drop("_chunk"))


def with_next(states: DataFrame) -> DataFrame:
    """Adds next_us, the start of the worker's following state."""
    cut = even_chunk(states, ["ts", "id"]).withColumn("us", micros(F.col("ts")))
    return neighbours(cut, ["worker"], "_chunk", ["ts", "id"],
                      following={"next_us": "us"}).drop("_chunk")


def dwell(states: DataFrame) -> DataFrame:
    """Time spent per status; a worker's last, open state has no length yet."""
    timed = with_next(states)
    return timed.groupBy("status").agg(
        F.count("*").alias("visits"),
        F.coalesce(F.sum(F.col("next_us") - F.col("us")), F.lit(0)).cast("bigint").alias("micros"))


def cooldown_remaining(blocked_us: Column, now_us: Column,
                       seconds: int = fixed.COOLDOWN_SECONDS) -> Column:
    """Whole seconds left of a cooldown, 0 when it is over."""
    left = F.floor((blocked_us + F.lit(seconds * 1000000) - now_us) / F.lit(1000000))
    return F.greatest(F.lit(0), left.cast("bigint"))


def snapshot(states: DataFrame, blocked: str = "BLOCKED", seconds: int = fixed.COOLDOWN_SECONDS,
             now: Column | None = None) -> DataFrame:
    """The latest state of each worker and what is left of its cooldown.

    Only states up to ``now`` count; without it that is the newest time in the table.
    """
    timed = states.withColumn("us", micros(F.col("ts")))
    if now is not None:
        timed = timed.where(F.col("us") <= micros(now))
    last = timed.groupBy("worker").agg(
        F.max_by("status", F.struct("ts", "id")).alias("status"), F.max("us").alias("us"))
    latest = micros(now) if now is not None else timed.agg(F.max("us").alias("now_us")).scalar()
    left = F.when(F.col("status") == blocked,
                  cooldown_remaining(F.col("us"), latest, seconds)).otherwise(F.lit(0))
    return last.select("worker", "status", left.cast("bigint").alias("cooldown_s"))


def pool_totals(states: DataFrame, submitted: Column, processed: Column) -> DataFrame:
    """One row: workers seen, URLs submitted, processed and still queued."""
    return states.agg(
        F.count_distinct("worker").alias("workers"), F.count_if(submitted).alias("submitted"),
        F.count_if(processed).alias("processed"),
        (F.count_if(submitted) - F.count_if(processed)).alias("queued"))


def in_state(snap: DataFrame, status: str = "AVAILABLE") -> DataFrame:
    return snap.where(F.col("status") == status).select("worker")


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def retry_outcomes(attempts: DataFrame, retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """Failed attempts with ``outcome``: requeue for the first ones, then discard.

    Only the first ``retries`` failures of a URL need a number. Ranking them
    lets Spark cut each group to that many rows before the shuffle, and the
    join back is on the attempt itself, so no URL gathers in one task.
    """
    failed = attempts.where(~F.col("ok"))
    order = Window.partitionBy("url").orderBy("ts", "attempt_id")
    early = (failed.select("url", "ts", "attempt_id")
             .withColumn("retry_no", F.row_number().over(order))
             .where(F.col("retry_no") <= retries).select("url", "attempt_id", "retry_no"))
    return (failed.join(early, ["url", "attempt_id"], "left")
            .withColumn("outcome", F.when(F.col("retry_no").isNotNull(), F.lit("requeue"))
                        .otherwise(F.lit("discard"))))


def progress_series(events: DataFrame, submitted: Column, processed: Column) -> DataFrame:
    """Running totals over the whole log: submitted, processed, queued."""
    cut = even_chunk(events, ["ts", "id"])
    out = running(cut, [], "_chunk", ["ts", "id"],
                  sums={"submitted": submitted.cast("bigint"), "processed": processed.cast("bigint")})
    return out.withColumn("queued", F.col("submitted") - F.col("processed")).drop("_chunk")
