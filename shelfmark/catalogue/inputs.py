"""Inputs that Spark derives from the test tables, next to their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.catalogue.registry import Tables

ORIGIN = "https://site.example"
LANGUAGES = ["en", "es", "fr", "de"]


# -- raw URL list lines ---------------------------------------------------------
_MARKS = ["- ", "-- ", "# ", "  ", " - ", "- # ", ""]

LINES_SQL = """
    SELECT page_id * 3 AS pos,
           ['- ', '-- ', '# ', '  ', ' - ', '- # ', ''][page_id % 7 + 1] || url ||
           CASE page_id % 3 WHEN 0 THEN ' local/' || page_id || '.html'
                            WHEN 1 THEN '  ' ELSE '' END AS line
    FROM pages
    UNION ALL SELECT page_id * 3 + 1, url FROM pages
    UNION ALL SELECT page_id * 3 + 2, '   ' FROM pages"""
TRIMMED_SQL = f"""
    SELECT pos, trim(line) AS line FROM ({LINES_SQL}) WHERE trim(line) <> ''"""
KEPT_SQL = f"""
    SELECT pos, line FROM ({TRIMMED_SQL}) WHERE NOT starts_with(line, '#')"""
PREPROCESSED_SQL = f"""
    SELECT pos, regexp_replace(line, '^\\s*--?\\s+', '') AS line FROM ({KEPT_SQL})"""


def canonical_sql(c: str) -> str:
    return (f"CASE WHEN contains({c}, '.html') THEN "
            f"left({c}, strpos({c}, '.html') + 4) ELSE {c} END")


def url_lines(t: Tables) -> DataFrame:
    """Three lines per page: marked and padded, plain, blank."""
    page = F.col("page_id")
    mark = F.get(F.array(*[F.lit(m) for m in _MARKS]), page % 7)
    tail = (F.when(page % 3 == 0, F.concat(F.lit(" local/"), page.cast("string"), F.lit(".html")))
            .when(page % 3 == 1, F.lit("  ")).otherwise(F.lit("")))
    lines = F.array(F.concat(mark, F.col("url"), tail), F.col("url"), F.lit("   "))
    return t.pages.select("page_id", F.posexplode(lines).alias("n", "line")).select(
        (page * 3 + F.col("n")).alias("pos"), "line")


# -- listing pages ----------------------------------------------------------------
def _language(c: Column) -> Column:
    return F.regexp_extract(c, "^https?://[^/]+/([^/]+)/", 1)


def listing_pages(t: Tables) -> DataFrame:
    """Every landed page as a listing page: its language is the category."""
    langs = F.array(*[F.lit(x) for x in LANGUAGES])
    return t.spread("pages", "page_id", "url", "html").select(
        F.array_position(langs, _language(F.col("url"))).cast("int").alias("cat_idx"),
        F.col("page_id").alias("page_num"), F.col("url").alias("page_url"), "html")


LISTING_BLOCKED = ["pills", "ref=x"]
_CAT_SQL = ("list_position(['en', 'es', 'fr', 'de'], "
            "regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1))::INTEGER")
PAGES_SQL = f"""
    SELECT {_CAT_SQL} AS cat_idx, page_id AS page_num,
           (contains(lower(url), 'pills') OR contains(lower(url), 'ref=x')) AS blocked
    FROM pages"""
_HREF = "regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)"
ALL_LINKS_SQL = f"""
    SELECT DISTINCT cat_idx, page_num, blocked,
           CASE WHEN starts_with(u, '/') THEN '{ORIGIN}' || u ELSE u END AS url
    FROM (SELECT cat_idx, page_num, blocked, {canonical_sql("h")} AS u
          FROM (SELECT {_CAT_SQL} AS cat_idx, page_id AS page_num,
                       (contains(lower(url), 'pills') OR contains(lower(url), 'ref=x')) AS blocked,
                       unnest({_HREF}) AS h FROM pages)
          WHERE contains(h, '/'))"""
LINKS_SQL = f"SELECT cat_idx, page_num, url FROM ({ALL_LINKS_SQL}) WHERE NOT blocked"


# -- states, attempts, messages from the event stream ---------------------------------
STATUS = {"view": "AVAILABLE", "click": "SCRAPING", "error": "BLOCKED",
          "signup": "STOPPED", "purchase": "DONE"}
STATUS_SQL = ("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())
              + " END")
STATES_SQL = (f"SELECT event_id AS id, ts, user_id AS worker, {STATUS_SQL} AS status FROM events")


def states(t: Tables) -> DataFrame:
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("event_type")]
    return t.events.select(F.col("event_id").alias("id"), "ts",
                           F.col("user_id").alias("worker"), status.alias("status"))


ATTEMPTS_SQL = """
    SELECT event_id AS attempt_id, ts, 'https://site.example/p-' || user_id || '.html' AS url,
           event_type <> 'error' AS ok FROM events"""


def attempts(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("attempt_id"), "ts",
        F.format_string("https://site.example/p-%d.html", "user_id").alias("url"),
        (F.col("event_type") != "error").alias("ok"))


MESSAGES = [
    "429 RESOURCE_EXHAUSTED quota", "daily limit reached", "billing: insufficient_quota",
    "404 NOT_FOUND model", "503 UNAVAILABLE", "generated value missing", "KeyError:",
    "quota per-minute used up", "quota per_day used up", "Rate limit hit", "Too Many Requests",
    "usage_limit_exceeded", "token limit of model", "capacity exhausted", "quota is gone",
    "insufficient_QUOTA daily", "400 INVALID_ARGUMENT bad request", "PERMISSION_DENIED 403",
    "401 unauthenticated", "422 unprocessable entity", "FAILED_PRECONDITION", "api key not valid",
    "deadline exceeded 504", "connection reset by peer", "502 bad gateway", "plain failure",
]
MESSAGES_SQL = ("SELECT event_id, [" + ", ".join(f"'{m}'" for m in MESSAGES)
                + f"][event_id % {len(MESSAGES)} + 1] || ' ' || event_type || ' ' || props"
                  " AS message FROM events")


def messages(t: Tables) -> DataFrame:
    texts = F.array(*[F.lit(m) for m in MESSAGES])
    return t.events.select("event_id", F.concat_ws(
        " ", F.get(texts, F.col("event_id") % len(MESSAGES)), "event_type", "props").alias("message"))


# log lines: level by value, worker by user, one line per event
LOG_SQL = f"""
    SELECT event_id AS pos, strftime(ts, '%H:%M:%S') AS log_time, 'Browser-' || user_id AS worker,
           {STATUS_SQL} AS status,
           CASE WHEN value > 100 THEN 'ERROR' WHEN value > 20 THEN 'WARNING' ELSE 'INFO' END AS level,
           '[AVAILABLE→' || {STATUS_SQL} || '] https://site.example/p-' || event_id || '.html' AS message,
           'AVAILABLE' AS old_status, {STATUS_SQL} AS new_status,
           'https://site.example/p-' || event_id || '.html' AS url
    FROM events"""


def log_lines(t: Tables) -> DataFrame:
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("event_type")]
    colour = F.when(F.col("value") > 100, "91").when(F.col("value") > 20, "93").otherwise("92")
    return t.events.select(F.col("event_id").alias("pos"), F.format_string(
        "\x1b[%sm%s [Browser-%d] [%s] [AVAILABLE→%s] https://site.example/p-%d.html\x1b[0m",
        colour, F.date_format("ts", "HH:mm:ss"), "user_id", status, status, "event_id").alias("line"))


# -- work list and store from the orders ---------------------------------------------
ORDER_URL = "https://site.example/order-%d.html"
WORK_SQL = "SELECT 'https://site.example/order-' || o_orderkey || '.html' AS url FROM orders"
STORE_SQL = """
    SELECT 'https://site.example/order-' || o_orderkey || '.html' AS url,
           CASE o_orderpriority WHEN '5-LOW' THEN ' N/A ' WHEN '1-URGENT' THEN 'Unknown Product'
                                ELSE 'Order ' || o_custkey END AS name
    FROM orders WHERE o_orderstatus = 'F'"""


def work_list(t: Tables) -> DataFrame:
    url = F.format_string(ORDER_URL, "o_orderkey")
    return t.orders.select(url.alias("url"), url.alias("line"))


def order_store(t: Tables) -> DataFrame:
    """Finished orders stand for stored products; some carry unusable names."""
    name = (F.when(F.col("o_orderpriority") == "5-LOW", " N/A ")
            .when(F.col("o_orderpriority") == "1-URGENT", "Unknown Product")
            .otherwise(F.format_string("Order %d", "o_custkey")))
    return t.orders.where(F.col("o_orderstatus") == "F").select(
        F.format_string(ORDER_URL, "o_orderkey").alias("url"), name.alias("name"))
