"""Operational logs and API errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import fixed_values as fixed
from shelfmark.catalogue import inputs as i
from shelfmark.catalogue.registry import query
from shelfmark.functions import apierrors as api, replies
from shelfmark.operators import oplog
from shelfmark.session import work_path
from shelfmark.sources import logs


@query("log_parse", i.LOG_SQL)
def log_parse(t):
    return oplog.parse_lines(i.log_lines(t)).drop("line")


@query("log_scan", f"""
    SELECT worker, status, level, count(*) AS n FROM ({i.LOG_SQL}) GROUP BY ALL""")
def log_scan(t):
    path = work_path(t.spark, "log")
    i.log_lines(t).select("line").write.text(path)
    return logs.read_log(t.spark, path).groupBy("worker", "status", "level").agg(F.count("*").alias("n"))


@query("log_dates", """
    SELECT event_id AS pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def log_dates(t):
    parsed = oplog.parse_lines(i.log_lines(t)).select("pos", "log_time")
    dated = oplog.with_dates(parsed, "2024-01-01")
    return dated.select("pos", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("log_to_dwell", f"""
    SELECT status, count(*) AS visits, coalesce(sum(nxt - us), 0)::BIGINT AS micros
    FROM (SELECT status, epoch_us(date_trunc('second', ts)) AS us, lead(epoch_us(date_trunc('second', ts)))
                 OVER (PARTITION BY worker ORDER BY date_trunc('second', ts), id) AS nxt
          FROM ({i.STATES_SQL})) GROUP BY status""")
def log_to_dwell(t):
    """Written log files, a folder per day, to the time spent in each state."""
    path = work_path(t.spark, "logs")
    lines = i.log_lines(t).join(t.events.select(F.col("event_id").alias("pos"), F.to_date("ts").alias("day")), "pos")
    (lines.repartition("day").sortWithinPartitions("day", "pos").select("day", "line")
     .write.partitionBy("day").text(path))
    dated = oplog.with_dates(logs.read_log(t.spark, path), F.col("day"), ["block", "row"], ["file"])
    number = F.regexp_extract("url", "p-([0-9]+)", 1).cast("bigint")
    return oplog.dwell(dated.select(number.alias("id"), "ts", "worker", "status"))


@query("status_transitions", f"""
    SELECT id, worker, coalesce(lag(status) OVER (PARTITION BY worker ORDER BY ts, id), '?') AS old_status,
           status AS new_status FROM ({i.STATES_SQL})""")
def status_transitions(t):
    return oplog.transitions(i.states(t)).select("id", "worker", "old_status", "new_status")


@query("transition_counts", f"""
    SELECT old_status, new_status, count(*) AS n FROM (
        SELECT coalesce(lag(status) OVER (PARTITION BY worker ORDER BY ts, id), '?') AS old_status,
               status AS new_status FROM ({i.STATES_SQL})) GROUP BY ALL""")
def transition_counts(t):
    return oplog.transitions(i.states(t)).groupBy("old_status", "new_status").agg(F.count("*").alias("n"))


@query("status_dwell", f"""
    SELECT status, count(*) AS visits, coalesce(sum(nxt - us), 0)::BIGINT AS micros
    FROM (SELECT status, epoch_us(ts) AS us,
                 lead(epoch_us(ts)) OVER (PARTITION BY worker ORDER BY ts, id) AS nxt
          FROM ({i.STATES_SQL})) GROUP BY status""")
def status_dwell(t):
    return oplog.dwell(i.states(t))


@query("cooldown_remaining", f"""
    SELECT id, greatest(0, floor((us + 180000000 - nxt) / 1000000.0::DOUBLE)::BIGINT) AS remaining_s
    FROM (SELECT id, status, epoch_us(ts) AS us,
                 lead(epoch_us(ts)) OVER (PARTITION BY worker ORDER BY ts, id) AS nxt
          FROM ({i.STATES_SQL})) WHERE status = 'BLOCKED' AND nxt IS NOT NULL""")
def cooldown_remaining(t):
    """What was left of each block when the worker's next state began."""
    timed = oplog.with_next(i.states(t)).where(
        (F.col("status") == "BLOCKED") & F.col("next_us").isNotNull())
    left = oplog.cooldown_remaining(F.col("us"), F.col("next_us"))
    return timed.select("id", left.alias("remaining_s"))


_SNAPSHOT = f"""
    SELECT worker, arg_max(status, (ts, id)) AS status, epoch_us(max(ts)) AS us FROM ({i.STATES_SQL})
    GROUP BY worker"""
_SNAPPED = f"""
    SELECT worker, status, CASE WHEN status = 'BLOCKED' THEN greatest(0, floor(
        (us + 180000000 - (SELECT epoch_us(max(ts)) FROM events)) / 1000000.0::DOUBLE)::BIGINT)
        ELSE 0 END AS cooldown_s FROM ({_SNAPSHOT})"""


@query("status_snapshot", _SNAPPED)
def status_snapshot(t):
    return oplog.snapshot(i.states(t))


_NOW, _HELD = "2024-01-15 12:00:00", 86400


@query("status_cooldown_at", f"""
    SELECT worker, status, CASE WHEN status = 'BLOCKED' THEN greatest(0, floor(
        (us + {_HELD}000000 - epoch_us(TIMESTAMP '{_NOW}')) / 1000000.0::DOUBLE)::BIGINT) ELSE 0 END AS cooldown_s
    FROM (SELECT worker, arg_max(status, (ts, id)) AS status, epoch_us(max(ts)) AS us
          FROM ({i.STATES_SQL}) WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY worker)""")
def status_cooldown_at(t):
    """States at a time inside the log, when cooldowns of a day are still running."""
    return oplog.snapshot(i.states(t), seconds=_HELD, now=F.lit(_NOW).cast("timestamp_ntz"))


@query("status_available", f"SELECT worker FROM ({_SNAPPED}) WHERE status = 'AVAILABLE'")
def status_available(t):
    return oplog.in_state(oplog.snapshot(i.states(t)))


@query("pool_totals", """
    SELECT count(DISTINCT user_id) AS workers, count(*) FILTER (event_type = 'signup') AS submitted,
           count(*) FILTER (event_type = 'purchase') AS processed,
           count(*) FILTER (event_type = 'signup') - count(*) FILTER (event_type = 'purchase') AS queued
    FROM events""")
def pool_totals(t):
    return oplog.pool_totals(i.states(t), F.col("status") == "STOPPED", F.col("status") == "DONE")


@query("status_counts", f"SELECT status, count(*) AS n FROM ({_SNAPPED}) GROUP BY status")
def status_counts(t):
    return oplog.status_counts(oplog.snapshot(i.states(t)))


RETRY_SQL = f"""
    SELECT attempt_id, url, CASE WHEN rn <= 2 THEN rn END::INTEGER AS retry_no,
           CASE WHEN rn <= 2 THEN 'requeue' ELSE 'discard' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, attempt_id) AS rn
          FROM ({i.ATTEMPTS_SQL}) WHERE NOT ok)"""


@query("retry_outcome", RETRY_SQL)
def retry_outcome(t):
    return oplog.retry_outcomes(i.attempts(t)).select("attempt_id", "url", "retry_no", "outcome")


@query("progress_series", """
    SELECT event_id AS id, count(*) FILTER (event_type = 'signup') OVER w AS submitted,
           count(*) FILTER (event_type = 'purchase') OVER w AS processed,
           count(*) FILTER (event_type = 'signup') OVER w
             - count(*) FILTER (event_type = 'purchase') OVER w AS queued
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def progress_series(t):
    rows = t.events.withColumnRenamed("event_id", "id")
    out = oplog.progress_series(rows, F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return out.select("id", "submitted", "processed", "queued")


def _mentions(words):
    return "(" + " OR ".join(f"contains(m, '{w}')" for w in words) + ")"


_CLASS = (f"CASE WHEN {_mentions(fixed.QUOTA_WORDS)} THEN 'quota' WHEN {_mentions(fixed.PERMANENT_WORDS)} "
          f"THEN 'permanent' WHEN {_mentions(fixed.RETRYABLE_WORDS)} THEN 'retryable' ELSE 'other' END")
_LOWERED = f"(SELECT event_id, message, lower(message) AS m FROM ({i.MESSAGES_SQL}))"


@query("error_class", f"SELECT event_id, {_CLASS} AS error_class FROM {_LOWERED}")
def error_class(t):
    return i.messages(t).select("event_id", api.error_class(F.col("message")).alias("error_class"))


_LABEL = "CASE " + " ".join(
    "WHEN " + " OR ".join("(" + " AND ".join(f"contains(m, '{w}')" for w in ws) + ")" for ws in alts)
    + f" THEN '{label}'" for label, alts in fixed.QUOTA_LABELS) + " ELSE 'QUOTA_EXHAUSTED' END"


@query("error_quota_label", f"""
    SELECT event_id, {_LABEL} AS label, CASE WHEN contains(m, '429') THEN 429 END AS code
    FROM {_LOWERED} WHERE {_CLASS} = 'quota'""")
def error_quota_label(t):
    m = F.col("message")
    return i.messages(t).where(api.error_class(m) == "quota").select(
        "event_id", api.quota_label(m).alias("label"), api.quota_code(m).alias("code"))


@query("error_permanent_label", f"""
    SELECT event_id, CASE {" ".join(f"WHEN contains(m, '{c}') THEN {c}" for c in fixed.PERMANENT_CODES)} END AS code,
           CASE {" ".join(f"WHEN contains(m, '{x.lower()}') THEN '{x}'" for x in fixed.PERMANENT_LABELS)} END AS label
    FROM {_LOWERED} WHERE {_CLASS} = 'permanent'""")
def error_permanent_label(t):
    m = F.col("message")
    return i.messages(t).where(api.error_class(m) == "permanent").select(
        "event_id", api.permanent_code(m).alias("code"), api.permanent_label(m).alias("label"))


@query("backoff_wait", f"""
    SELECT user_id, count(*) AS failures, sum(CASE WHEN attempt <= 3 THEN 15 * (1 << (attempt - 1)::INTEGER) END)::BIGINT
           AS wait_s FROM (SELECT user_id, event_id % 4 + 1 AS attempt FROM events WHERE event_type = 'error')
    GROUP BY user_id""")
def backoff_wait(t):
    failed = t.events.where(F.col("event_type") == "error")
    wait = api.backoff_seconds(F.col("event_id") % 4 + 1)
    return failed.groupBy("user_id").agg(F.count("*").alias("failures"),
                                         F.sum(wait).cast("bigint").alias("wait_s"))


_REPLIES = """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```'
           WHEN 1 THEN 'Sure, here it is: ' || props || ' done' WHEN 2 THEN 'nothing to see'
           WHEN 3 THEN '{"is_cleared": true, "in": ' || props || '}' ELSE 'broken {"k": ' END AS reply,
           event_id % 5 AS kind, json_extract_string(props, '$.k')::BIGINT AS k FROM events"""


@query("json_salvage", f"""
    SELECT event_id, kind IN (0, 1, 3) AS parsed, CASE WHEN kind IN (0, 1) THEN k END AS k,
           CASE WHEN kind = 3 THEN k END AS inner_k FROM ({_REPLIES})""")
def json_salvage(t):
    kind = F.col("event_id") % 5
    reply = (F.when(kind == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
             .when(kind == 1, F.concat(F.lit("Sure, here it is: "), "props", F.lit(" done")))
             .when(kind == 2, "nothing to see")
             .when(kind == 3, F.concat(F.lit('{"is_cleared": true, "in": '), "props", F.lit("}")))
             .otherwise('broken {"k": '))
    found = t.events.select("event_id", replies.salvage_json(reply).alias("v"))
    return found.select("event_id", F.col("v").isNotNull().alias("parsed"),
                        F.try_variant_get("v", "$.k", "bigint").alias("k"),
                        F.try_variant_get("v", "$.in.k", "bigint").alias("inner_k"))
