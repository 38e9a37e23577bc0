"""Quality gate, price rules, resume and the product store."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.catalogue import inputs as i, q_products, render as r
from shelfmark.catalogue.registry import query
from shelfmark.operators import gate, products as p, store
from shelfmark.schema import PRODUCT_COLUMNS
from shelfmark.session import saved, work_path
from shelfmark.sources import products as source

_BAD_NAME = "trim(name) IN ('', 'Unknown Product', 'None', 'none', 'null', 'N/A')"
_BAD_PRICE = "trim(current_price_integer) IN ('', '0', 'None', 'none')"

# Records from line items: some carry unusable names or prices.
_RECORDS = """
    SELECT l_orderkey, l_linenumber,
           CASE l_linestatus || l_linenumber WHEN 'F1' THEN ' N/A ' WHEN 'O2' THEN 'Unknown Product'
                WHEN 'F3' THEN NULL WHEN 'O4' THEN ' ' ELSE 'Part ' || l_partkey END AS name,
           CASE WHEN l_discount = 0 THEN '0' WHEN l_tax = 0 THEN ' None'
                ELSE l_extendedprice::BIGINT::VARCHAR END AS current_price_integer
    FROM lineitem"""


def _records(t):
    tag = F.concat(F.col("l_linestatus"), F.col("l_linenumber").cast("string"))
    name = (F.when(tag == "F1", " N/A ").when(tag == "O2", "Unknown Product")
            .when(tag == "F3", F.lit(None)).when(tag == "O4", " ")
            .otherwise(F.format_string("Part %d", "l_partkey")))
    price = (F.when(F.col("l_discount") == 0, "0").when(F.col("l_tax") == 0, " None")
             .otherwise(F.rint("l_extendedprice").cast("bigint").cast("string")))
    return t.lineitem.select("l_orderkey", "l_linenumber", name.alias("name"),
                             price.alias("current_price_integer"))


@query("gate_valid", f"""
    SELECT l_orderkey, count(*) AS products FROM ({_RECORDS})
    WHERE NOT (name IS NULL OR {_BAD_NAME}) AND NOT {_BAD_PRICE} GROUP BY l_orderkey""")
def gate_valid(t):
    return gate.valid_products(_records(t)).groupBy("l_orderkey").agg(F.count("*").alias("products"))


@query("gate_reasons", f"""
    SELECT CASE WHEN name IS NULL OR {_BAD_NAME} THEN 'invalid_name' WHEN {_BAD_PRICE} THEN 'invalid_price'
                ELSE 'ok' END AS reason, count(*) AS products FROM ({_RECORDS}) GROUP BY reason""")
def gate_reasons(t):
    return gate.reason_counts(_records(t))


# Both prices in whole cents; some pairs inverted, some percents off by one.
_PRICES = """
    SELECT l_returnflag, CASE WHEN l_linenumber = 5 THEN b ELSE a END AS o,
           CASE WHEN l_linenumber = 5 THEN a ELSE b END AS c,
           (round(l_discount * 100) + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END)::INTEGER AS pct
    FROM (SELECT *, round(l_extendedprice * 100)::BIGINT AS a,
                 floor(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) / 100)::BIGINT AS b
          FROM lineitem)"""


@query("price_consistency", f"""
    SELECT l_returnflag, count(*) AS n, count(*) FILTER (o < c) AS inverted,
           count(*) FILTER (pct <> off) AS mismatched, count(*) FILTER (o <> c) AS shown,
           sum(greatest(o, c))::BIGINT AS old_cents, sum(least(o, c))::BIGINT AS current_cents
    FROM (SELECT *, round_even((greatest(o, c) / 100.0::DOUBLE - least(o, c) / 100.0::DOUBLE)
                 / (greatest(o, c) / 100.0::DOUBLE) * 100.0::DOUBLE, 0)::INTEGER AS off FROM ({_PRICES}))
    GROUP BY l_returnflag""")
def price_consistency(t):
    a = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    pct = F.round(F.col("l_discount") * 100).cast("bigint")
    b = F.floor(a * (F.lit(100) - pct) / 100)
    five = F.col("l_linenumber") == 5

    def price(cents):
        return (cents.cast("decimal(18,0)") / 100).cast("decimal(18,2)")
    rows = t.lineitem.select(
        "l_returnflag", price(F.when(five, b).otherwise(a)).alias("old_price"),
        price(F.when(five, a).otherwise(b)).alias("current_price"),
        (pct + F.when(F.col("l_linenumber") == 3, 1).otherwise(0)).cast("int").alias("discount_pct"))
    checked = gate.with_price_checks(rows)
    return checked.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if("price_inverted").alias("inverted"),
        F.count_if("discount_mismatch").alias("mismatched"), F.count_if("show_discount").alias("shown"),
        F.sum((F.col("fixed_old") * 100).cast("bigint")).alias("old_cents"),
        F.sum((F.col("fixed_current") * 100).cast("bigint")).alias("current_cents"))


_DONE = f"""
    SELECT url FROM ({i.STORE_SQL}) WHERE lower(trim(name)) NOT IN ('', 'none', 'null', 'n/a', 'na')"""


@query("resume_anti", f"SELECT url FROM ({i.WORK_SQL}) WHERE url NOT IN ({_DONE})")
def resume_anti(t):
    return store.remaining(i.work_list(t), i.order_store(t)).select("url")


@query("resume_limit", f"""
    SELECT url FROM ({i.WORK_SQL}) WHERE url NOT IN ({_DONE}) ORDER BY lower(url), url LIMIT 500""")
def resume_limit(t):
    left = store.remaining(i.work_list(t), i.order_store(t))
    return store.limit_work(left, 500).select("url")


@query("resume_limit_half", f"""
    SELECT url FROM ({i.WORK_SQL}) WHERE url NOT IN ({_DONE}) ORDER BY lower(url), url
    LIMIT (SELECT count(*) // 2 FROM orders)""")
def resume_limit_half(t):
    """A target of half the table."""
    left = store.remaining(i.work_list(t), i.order_store(t))
    return store.limit_work(left, t.orders.count() // 2).select("url")


@query("progress_counts", f"""
    SELECT count(*) AS total, count(*) FILTER (url IN ({_DONE})) AS filtered_out,
           count(*) FILTER (url NOT IN ({_DONE})) AS remaining FROM ({i.WORK_SQL})""")
def progress_counts(t):
    return store.progress(i.work_list(t), i.order_store(t))


# First write: finished orders. Second write: every line item's order, so a URL
# comes as often as the order has lines; the earliest line number wins.
def _order_rows(t):
    lines = t.lineitem.select(
        F.format_string(i.ORDER_URL, "l_orderkey").alias("url"),
        (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("seq"),
        F.format_string("Part %d", "l_partkey").alias("name"))
    return lines


def _stored(t, label):
    path = work_path(t.spark, label)
    store.open_store(t.spark, path).append(source.in_store_form(i.order_store(t)))
    store.insert_if_absent(_order_rows(t), path, "seq")
    store.insert_if_absent(_order_rows(t), path, "seq")   # a replay must add nothing
    return source.read_store(t.spark, path)


_UPSERTED = f"""
    SELECT url, name FROM ({i.STORE_SQL})
    UNION ALL
    SELECT 'https://site.example/order-' || l_orderkey || '.html' AS url,
           'Part ' || arg_min(l_partkey, l_linenumber::BIGINT * 100000000 + l_partkey) AS name
    FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    GROUP BY l_orderkey"""


@query("products_upsert", _UPSERTED)
def products_upsert(t):
    return _stored(t, "store").select("url", "name")


@query("products_count", f"SELECT count(*) AS products FROM ({_UPSERTED})")
def products_count(t):
    return store.stored_count(_stored(t, "store-count"))


@query("products_read", f"""
    SELECT url, name, product_name_safe, sku, sizes, current_price_integer, description, is_international
    FROM ({q_products.RECORDS_SQL})""")
def products_read(t):
    path = work_path(t.spark, "products-json")
    source.write_json(p.extract_products(r.render_pages(t)), path)
    back = source.read_json(t.spark, path, layout="lines")
    return back.select("url", "name", "product_name_safe", "sku",
                       F.array_join("available_sizes", ",").alias("sizes"),
                       "current_price_integer", "description", "is_international")


@query("products_read_array", f"""
    SELECT url, name, product_name_safe, sku, sizes, current_price_integer, description, is_international
    FROM ({q_products.RECORDS_SQL})""")
def products_read_array(t):
    """All records as JSON arrays without line ends, one file per part, read piece by piece."""
    path = work_path(t.spark, "products-array")
    records = saved(p.extract_products(r.render_pages(t)).select(
        F.to_json(F.struct(*PRODUCT_COLUMNS), {"ignoreNullFields": "false"}).alias("value")), "records")
    numbered = records.select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n"))
    ends = numbered.groupBy("part").agg(F.min("n").alias("first"), F.max("n").alias("last"))  # a row per file
    (numbered.join(F.broadcast(ends), "part")
     .select(F.concat(F.when(F.col("n") == F.col("first"), "[").otherwise(", "), "value",
                      F.when(F.col("n") == F.col("last"), "]").otherwise("")).alias("value"))
     .write.option("lineSep", " ").text(path))
    back = source.read_json(t.spark, path, layout="array")
    return back.select("url", "name", "product_name_safe", "sku",
                       F.array_join("available_sizes", ",").alias("sizes"),
                       "current_price_integer", "description", "is_international")
