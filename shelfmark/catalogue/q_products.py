"""Names, money and the product record over rendered pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.catalogue import name_sql, render as r
from shelfmark.catalogue.registry import query
from shelfmark.functions import money, names
from shelfmark.operators import products as p
from shelfmark.operators.blocks import SpecLimits
from shelfmark.operators.markup import ExtractConfig, parse_pages

_H1 = ("replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&quot;', '\"'), '&amp;', '&')")


@query("product_name", f"""
    SELECT page_id, coalesce(nullif(name, ''), 'Unknown Product') AS name
    FROM ({name_sql.normalized(f"SELECT page_id, {_H1} AS raw FROM pages", 'raw', 'page_id')})""")
def product_name(t):
    return p.extract_fields(t.spread("pages", "page_id", "html"), "name", keep=("page_id",)).select("page_id", "name")


@query("name_normalize", name_sql.normalized("SELECT doc_id, text FROM documents", "text", "doc_id"))
def name_normalize(t):
    # Many splits of a file can be empty, as a row group is read by one task alone: the texts are dealt out in any case.
    texts = t.documents.select("doc_id", "text").repartition(4 * t.spark.sparkContext.defaultParallelism)
    return texts.select("doc_id", names.normalize_name(F.col("text")).alias("name"))


@query("name_safe", f"SELECT page_id, {name_sql.safe('url')} AS safe FROM pages")
def name_safe(t):
    return t.pages.select("page_id", names.safe_name(F.col("url")).alias("safe"))


def _cents(column: str):
    return (F.col(column) * 100).cast("bigint")


_MONEY = "regexp_extract(translate(text, 'R$€£¥', ''), '([0-9.]+)[,.]([0-9]{2})', "


@query("money_parse", f"""
    SELECT doc_id, nullif(replace({_MONEY} 1), '.', ''), '') AS integer_part,
           CASE WHEN replace({_MONEY} 1), '.', '') <> '' THEN {_MONEY} 2) END AS decimal_part
    FROM documents""")
def money_parse(t):
    text = F.col("text")
    return t.spread("documents", "doc_id", "text").select("doc_id", money.price_integer(text).alias("integer_part"),
                              money.price_decimal(text).alias("decimal_part"))


@query("price_current", f"""
    SELECT url, cur_i AS current_price_integer, cur_d AS current_price_decimal,
           CASE WHEN v <> 5 THEN pc END AS current_price_cents FROM ({r.PRICES_SQL})""")
def price_current(t):
    out = p.extract_fields(r.render_pages(t), "price")
    return out.select("url", "current_price_integer", "current_price_decimal",
                      _cents("current_price").alias("current_price_cents"))


@query("price_old", f"""
    SELECT url, old_i AS old_price_integer, old_d AS old_price_decimal, typed_old AS old_price_cents
    FROM ({r.PRICES_SQL})""")
def price_old(t):
    out = p.extract_fields(r.render_pages(t), "price")
    return out.select("url", "old_price_integer", "old_price_decimal",
                      _cents("old_price").alias("old_price_cents"))


@query("price_typed", """
    SELECT page_id, cents AS current_cents, CASE k WHEN 0 THEN 2 * cents WHEN 1 THEN cents + 12345
             WHEN 2 THEN (cents * 200 + 80) // 160 WHEN 3 THEN (cents * 2000 + 875) // 1750 ELSE (cents * 2000 + 925) // 1850 END AS old_cents,
           CASE k WHEN 0 THEN 50 WHEN 1 THEN round_even(12345.0::DOUBLE / 100 / ((cents + 12345)::DOUBLE / 100) * 100.0::DOUBLE, 0)::INTEGER
             WHEN 2 THEN 20 WHEN 3 THEN 12 ELSE 8 END AS discount_pct
    FROM (SELECT l_orderkey * 10 + l_linenumber AS page_id, round(l_extendedprice * 100)::BIGINT AS cents,
                 (l_orderkey + l_linenumber) % 5 AS k FROM lineitem)""")
def price_typed(t):
    k, cents = F.col("k"), F.col("cents")

    def shown(c, group, point):
        whole = F.translate(F.format_number(F.floor(c / 100), 0), ",", group)
        return F.concat(whole, F.lit(point), F.format_string("%02d", c % 100))
    br, us = (lambda c: F.concat(F.lit("R$"), shown(c, ".", ","))), (lambda c: F.concat(F.lit("$"), shown(c, ",", ".")))
    plain = F.concat(F.lit("R$"), shown(cents, "", ","))
    now, old, off = '<div id="productMainPriceId">%s</div>', "<del>%s</del>", '<span class="x-discount">-%s%%</span>'
    html = (F.when(k == 0, F.format_string(now + old, br(cents), br(2 * cents)))
            .when(k == 1, F.format_string(now + old, us(cents), us(cents + 12345)))
            .when(k == 2, F.format_string(now + off, br(cents), F.lit("20")))
            .when(k == 3, F.format_string(now + off, us(cents), F.lit("12.5")))
            .otherwise(F.format_string(now + off, plain, F.lit("7,5"))))
    pages = t.spread("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_id"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 5).alias("k")).select("page_id", html.alias("html"))
    out = p.extract_fields(pages, "price", keep=("page_id",))
    return out.select("page_id", _cents("current_price").alias("current_cents"),
                      _cents("old_price").alias("old_cents"), "discount_pct")


@query("discount_pct", f"""
    SELECT url, coalesce(dnum || '%', 'N/A') AS discount_percentage, dnum AS discount_pct
    FROM ({r.PRICES_SQL})""")
def discount_pct(t):
    out = p.extract_fields(r.render_pages(t), "price")
    return out.select("url", "discount_percentage", "discount_pct")


@query("description_text", f"SELECT url, description FROM ({r.DESCRIPTION_SQL})")
def description_text(t):
    return p.extract_fields(r.render_pages(t), "description").select("url", "description")


@query("description_struct", f"""
    SELECT url, description AS text, CASE WHEN k % 3 <> 2 THEN 4 ELSE 0 END::INTEGER AS attributes,
           CASE WHEN k % 3 <> 2 THEN p_brand END AS brand FROM ({r.DESCRIPTION_SQL})""")
def description_struct(t):
    out = p.extract_fields(r.render_pages(t), "description")
    d = F.col("description_structured")
    return out.select("url", d["text"].alias("text"), F.size(d["attributes"]).alias("attributes"),
                      F.try_element_at(d["attributes"], F.lit("Brand")).alias("brand"))


@query("selector_table", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS name FROM part""")
def selector_table(t):
    """Selectors of another site: its own heading first, a label second."""
    k = F.col("p_partkey")
    pages = t.part.select("p_partkey", F.concat(
        F.lit("<h1>no name here</h1>"), F.when(k % 3 == 0, "<h2 class='title'> </h2>").otherwise(
            F.format_string("<h2 class='big title'>%s</h2>", "p_name")),
        F.format_string("<b data-role='brand'>%s</b>", "p_brand")).alias("html"))
    own = ExtractConfig(name=[("h2", "class", "is", "title"), ("b", "data-role", "is", "brand")])
    raw = parse_pages(pages, ("name",), keep=("p_partkey",), config=own)
    return raw.select("p_partkey", F.get(F.filter("name_c", lambda c: c != ""), F.lit(0)).alias("name"))


@query("name_options", "SELECT p_partkey, p_name || '_' || p_type || ' xl' AS name FROM part")
def name_options(t):
    """Reserved signs replaced, not dropped, and casing left alone."""
    raw = F.concat("p_name", F.lit("?"), "p_type", F.lit(",  xl "))
    return t.part.select("p_partkey", names.normalize_name(raw, replace_with="_", title=False).alias("name"))


@query("attr_pairs", f"""
    SELECT url, idx - 1 AS pos, key, value FROM (
        SELECT url, unnest([1, 2, 3, 4]) AS idx, unnest(['Brand', 'Type', 'Size', 'Pack']) AS key,
               unnest([p_brand, p_type, p_size::VARCHAR, 'no. ' || (k % 7)]) AS value
        FROM ({r.SOURCE_SQL}) WHERE k % 3 <> 2)""")
def attr_pairs(t):
    raw = p.with_blocks(parse_pages(r.render_pages(t), ("description",)))
    return raw.select("url", F.posexplode("attrs").alias("pos", "a")).select("url", "pos", "a.key", "a.value")


@query("attr_map", r.ATTRIBUTES_SQL)
def attr_map(t):
    out = p.extract_fields(r.render_pages(t), "description")
    return out.select("url", F.explode("description_structured.attributes").alias("key", "value"))


@query("attr_explode", f"SELECT key, value, count(*) AS products FROM ({r.ATTRIBUTES_SQL}) GROUP BY ALL")
def attr_explode(t):
    return attr_map(t).groupBy("key", "value").agg(F.count("*").alias("products"))


@query("spec_lines", f"""
    SELECT url, 'Fabric: Cotton ' || p_type AS spec FROM ({r.SOURCE_SQL}) WHERE k % 4 = 1""")
def spec_lines(t):
    raw = p.with_blocks(parse_pages(r.render_pages(t), ("description",)))
    return raw.select("url", F.explode("specs").alias("spec"))


@query("spec_lines_whole", f"""
    SELECT p_partkey, unnest(['Fabric: ' || trim(repeat(p_type || ' ', 60)),
                              trim(repeat('long label ', 8)) || ': ' || p_name || ' a b c d e f']) AS spec FROM part
    UNION ALL SELECT p_partkey, 'Second script: ' || p_brand AS spec FROM part WHERE p_partkey % 2 = 0""")
def spec_lines_whole(t):
    """Values, labels, texts behind a label and scripts beyond every limit of the contract."""
    entry = '<div class="common-entry__content"><b>%s</b>%s</div>'
    nodes = F.concat(*(F.format_string("<i>%s</i>", F.lit(x)) for x in "abcdef"))
    first = F.concat(
        F.format_string(entry, F.lit("Fabric:"), F.trim(F.repeat(F.concat("p_type", F.lit(" ")), 60))),
        F.format_string(entry, F.concat(F.repeat(F.lit("long label "), 8), F.lit(":")), F.concat(F.lit("<u>"), "p_name", F.lit("</u>"), nodes)))
    second = F.when(F.col("p_partkey") % 2 == 0, F.format_string(
        f"<script>{entry}</script>", F.lit("Second script:"), F.col("p_brand"))).otherwise("")
    # the narrow part rows are spread before they grow into pages, however few splits their files have
    part = t.part.select("p_partkey", "p_type", "p_name", "p_brand").repartition(t.spark.sparkContext.defaultParallelism)
    pages = part.select("p_partkey", F.concat(F.lit("<html><script>"), first, F.lit("</script>"), second, F.lit("</html>")).alias("html"))
    raw = p.with_blocks(parse_pages(pages, ("description",), keep=("p_partkey",), config=ExtractConfig(spec=SpecLimits())), SpecLimits())
    return raw.select("p_partkey", F.explode("specs").alias("spec"))


@query("goods_desc", f"SELECT url, 'Nice ' || p_type AS goods FROM ({r.SOURCE_SQL}) WHERE k % 4 = 2")
def goods_desc(t):
    raw = parse_pages(r.render_pages(t), ("description",))
    return raw.select("url", F.explode(p.goods_text(F.col("goods_desc"))).alias("goods"))


@query("shipping_status", f"""
    SELECT url, {r.SHIPPING_SQL} AS shipping_status, k % 5 = 2 AS is_international FROM ({r.SOURCE_SQL})""")
def shipping_status(t):
    return p.extract_fields(r.render_pages(t), "shipping").select("url", "shipping_status", "is_international")


@query("sku", f"SELECT url, {r.SKU_SQL} AS sku FROM ({r.SOURCE_SQL})")
def sku(t):
    return p.extract_fields(r.render_pages(t), "sku").select("url", "sku")


@query("sizes", f"SELECT url, {r.SIZES_SQL} AS sizes FROM ({r.SOURCE_SQL})")
def sizes(t):
    out = p.extract_fields(r.render_pages(t), "sizes")
    return out.select("url", F.array_join("available_sizes", ",").alias("sizes"))


@query("size_explode", f"""
    SELECT size, count(*) AS products FROM (
        SELECT unnest(string_split({r.SIZES_SQL}, ',')) AS size FROM ({r.SOURCE_SQL})) GROUP BY size""")
def size_explode(t):
    out = p.extract_fields(r.render_pages(t), "sizes")
    return out.select(F.explode("available_sizes").alias("size")).groupBy("size").agg(
        F.count("*").alias("products"))


@query("reviews", f"SELECT url, {r.REVIEWS_SQL} AS reviews FROM ({r.SOURCE_SQL})")
def reviews(t):
    return p.extract_fields(r.render_pages(t), "reviews").select("url", "reviews")


_NAMES = name_sql.normalized(f"SELECT url, label FROM ({r.SOURCE_SQL})", "label", "url")
RECORDS_SQL = f"""
    SELECT x.url, CASE WHEN x.v = 7 THEN 'Unknown Product' ELSE n.name END AS name,
           CASE WHEN x.v = 7 THEN 'Unknown Product' ELSE {name_sql.safe('n.name')} END AS product_name_safe,
           {r.SKU_SQL.replace(' k ', ' x.k ')} AS sku, {r.REVIEWS_SQL} AS reviews, {r.SIZES_SQL} AS sizes,
           cur_i AS current_price_integer, cur_d AS current_price_decimal,
           old_i AS old_price_integer, old_d AS old_price_decimal,
           coalesce(dnum || '%', 'N/A') AS discount_percentage, d.description,
           x.k % 5 = 2 AS is_international, {r.SHIPPING_SQL} AS shipping_status,
           CASE WHEN x.v <> 5 THEN x.pc END AS current_price_cents, typed_old AS old_price_cents, dnum AS discount_pct
    FROM ({r.PRICES_SQL}) x JOIN ({_NAMES}) n ON n.url = x.url
    JOIN (SELECT url, description FROM ({r.DESCRIPTION_SQL})) d ON d.url = x.url"""
RECORD_COLUMNS = ["url", "name", "product_name_safe", "sku", "reviews", "sizes",
                  "current_price_integer", "current_price_decimal", "old_price_integer",
                  "old_price_decimal", "discount_percentage", "description", "is_international",
                  "shipping_status", "current_price_cents", "old_price_cents", "discount_pct"]


def _records(t):
    made = p.extract_products(r.render_pages(t)).withColumn("sizes", F.array_join("available_sizes", ","))
    return (made.withColumn("current_price_cents", _cents("current_price"))
            .withColumn("old_price_cents", _cents("old_price")))


@query("products_extract", RECORDS_SQL)
def products_extract(t):
    return _records(t).select(*RECORD_COLUMNS)


@query("product_summary", f"""
    SELECT url, name || ' | ' || sku || ' | ' || reviews || ' | ' || replace(sizes, ',', ', ') || ' | R$'
        || old_price_integer || ',' || old_price_decimal || ' | R$' || current_price_integer || ','
        || current_price_decimal || ' | ' || discount_percentage || ' | ' || left(description, 100)
        || '...' AS line FROM ({RECORDS_SQL})""")
def product_summary(t):
    return _records(t).select("url", p.summary().alias("line"))


@query("product_card", f"""
    SELECT url, 'Product Name: ' || name || chr(10) || chr(10) || 'Price: From R$' || current_price_integer
        || ',' || current_price_decimal || ' to R$' || old_price_integer || ',' || old_price_decimal
        || ' (' || discount_percentage || ')' || chr(10) || chr(10) || 'Description: ' || description
        || chr(10) || chr(10) || '🛒 Find it online:' || chr(10) || '👉 ' || url AS card
    FROM ({RECORDS_SQL})""")
def product_card(t):
    return _records(t).select("url", p.card().alias("card"))
