"""Product pages rendered from ``part`` and ``lineitem``.

Every part becomes one page; its key decides which markup variants it uses, so
that all fallbacks occur at every scale. ``EXPECTED_SQL`` states what an
extraction must find, straight from the source columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.catalogue.registry import Tables

_URL = "https://site.example/item-p-%d.html"
_RADIO = '<div class="product-intro__size-radio%s"%s>%s</div>'


def _radio(text: str, aria: str = "", gone: bool = False) -> str:
    return _RADIO % (" product-intro__size-radio_soldout" if gone else "",
                     f' aria-label="{aria}"' if aria else "", text)


def _pick(selector: Column, texts: list) -> Column:
    return F.get(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts]), selector)


def _br(cents: Column) -> Column:
    """2299.08 as ``R$2.299,08``."""
    whole = F.floor(cents / 100)
    grouped = F.when(whole >= 1000, F.format_string("%d.%03d", F.floor(whole / 1000), whole % 1000)
                     ).otherwise(whole.cast("string"))
    return F.concat(F.lit("R$"), grouped, F.format_string(",%02d", cents % 100))


def render_pages(t: Tables) -> DataFrame:
    """page_id, url, html. Aggregated before the join, one row per part."""
    sold = t.lineitem.groupBy("l_partkey").agg(F.min("l_extendedprice").alias("low"),
                                               F.max("l_discount").alias("off"))
    # the narrow part rows are spread before they grow into pages
    cores = t.spark.sparkContext.defaultParallelism
    part = t.part.repartition(cores, "p_partkey")
    parts = part.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    k = F.col("p_partkey")

    def to_cents(c: Column) -> Column:
        return F.round(c * 100).cast("bigint")
    parts = (parts.withColumn("pc", to_cents(F.col("p_retailprice")))
             .withColumn("oc", to_cents(F.coalesce("low", "p_retailprice")))
             .withColumn("pct", F.round(F.coalesce("off", F.lit(0.0)) * 100).cast("int"))
             .withColumn("label", F.concat("p_name", F.lit(" / "), "p_brand", F.lit(", 5pcs women's"))))

    def usd(c: str) -> Column:
        return F.format_string("$%d.%02d", F.floor(F.col(c) / 100), F.col(c) % 100)
    parts = parts.withColumn("p_us", usd("pc")).withColumn("o_us", usd("oc"))

    heading = F.when(k % 8 == 7, "").when(
        k % 2 == 0, F.format_string('<h1 class="fsp-element">%s</h1>', "label")).otherwise(
        F.format_string('<span class="fsp-element"> </span><h1 class="main product-title">%s</h1>', "label"))
    js = '<script type="application/json">%s</script>'
    now = '{"promotionInfoPrice":{"amountWithSymbol":"%s"}'
    was = '{"originalPrice":{"amountWithSymbol":"%s"}}'
    price = _pick(k % 8, [
        F.format_string(js % (now + ',"deep":[' + was + "]}"), "p_us", "o_us"),
        F.format_string(js % ('{"detail":' + now + "}}")
                        + '<div class="productDiscountPercent">-%d%%</div>', "p_us", "pct"),
        F.format_string('<div id="productMainPriceId">%s</div>'
                        '<p class="productEstimatedTagNewRetail__retail">%s</p>',
                        _br(F.col("pc")), _br(F.col("oc"))),
        F.format_string('<div class="productPrice__main">%s</div><span class="x-discount">%d%%</span>',
                        "p_us", "pct"),
        F.format_string('<span class="price-current">%s</span>', "p_us"),
        "",
        F.format_string(js % '{"promotionInfoPrice":{"amountWithSymbol":12.5}}'
                        + js % ('{"b":' + was + ',"a":{"originalPrice":{"amountWithSymbol":"$1.00"}},'
                                + now[1:] + "}"), "o_us", "p_us"),
        F.format_string('<div class="sale-price">%s</div><del>%s</del>', "p_us", "o_us"),
    ])
    shipping = _pick(k % 5, [
        "",
        _radio("n", "Envio Nacional") + _radio("i", "International"),
        _radio("n", "Envio Nacional", True) + _radio("i", "International"),
        _radio("n", "Envio Nacional", True) + _radio("i", "International", True),
        _radio("n", "Envio Nacional"),
    ])
    sizes = F.concat(F.lit(_radio("S") + _radio("x", "M") + _radio("L", gone=True)),
                     F.format_string(_RADIO % ("", "", "%d"), "p_size"), F.lit(_radio("S")))
    note = _pick(k % 3, ["", "(12) ratings", "plain"])
    sku = F.when(k % 4 != 3, F.format_string(
        '<div class="wrap"><div><span>SKU: p%d</span></div><p>%d %s</p></div>', k, k, note)).otherwise("")
    review = F.when(k % 3 == 0, F.format_string(
        '<div class="common-reviews">4.%d <b>Review</b> of every %s item in this shop, sorted by date</div>',
        k % 10, "p_type")).otherwise("")
    about = F.when(k % 2 == 0, F.format_string(
        '<div class="product-intro__attr-des">%s <b>GOODS</b> OF %s</div>', "p_type", "p_brand")).otherwise("")
    block = F.when(k % 3 != 2, F.format_string(
        '<div name="ProductIntroDescription"><dl><dt>Brand</dt><dd>%s</dd></dl>'
        '<table><tr><td>Brand</td><td>other</td></tr><tr><th>Type</th><td>%s</td></tr></table>'
        '<li><b>Size</b> %d</li><p>Pack: no. %d</p><p>Loose text %d</p></div>',
        "p_brand", "p_type", "p_size", k % 7, k % 5)).otherwise("")
    specs = F.when(k % 4 == 1, F.format_string(
        "<script>var h='<div class=\"common-entry__content\"><b>Fabric:</b><i>Cotton %s</i>"
        "<b>Vendas: 3</b></div>';</script>", "p_type")).otherwise("")
    goods = F.when(k % 4 == 2, F.format_string(
        '<script>{"x":[{"goods_desc":"<p>Nice %s</p>"}]}</script>', "p_type")).otherwise("")
    html = F.concat(F.lit("<!DOCTYPE html><html><body>"), heading, price, shipping, sizes, sku,
                    review, about, block, specs, goods, F.lit("</body></html>"))
    return parts.select(k.alias("page_id"), F.format_string(_URL, k).alias("url"), html.alias("html"))


_LABEL_SQL = "p_name || ' / ' || p_brand || ', 5pcs women''s'"
_X = "(pc / 100.0::DOUBLE) / (1.0::DOUBLE - pct / 100.0::DOUBLE)"

SOURCE_SQL = f"""
    SELECT p_partkey AS k, p_brand, p_type, p_size, {_LABEL_SQL} AS label, p_partkey % 8 AS v,
           'https://site.example/item-p-' || p_partkey || '.html' AS url,
           round(p_retailprice * 100)::BIGINT AS pc,
           round(coalesce(low, p_retailprice) * 100)::BIGINT AS oc,
           round(coalesce(off, 0.0) * 100)::INTEGER AS pct
    FROM part LEFT JOIN (SELECT l_partkey, min(l_extendedprice) AS low, max(l_discount) AS off
                         FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey"""

# cents of the computed old price: exact half-even rounding of a double
PRICES_SQL = f"""
    SELECT *, CASE WHEN v <> 5 THEN (pc // 100)::VARCHAR ELSE '0' END AS cur_i,
           CASE WHEN v <> 5 THEN lpad((pc % 100)::VARCHAR, 2, '0') ELSE '00' END AS cur_d,
           CASE WHEN v IN (0, 2, 6, 7) THEN (oc // 100)::VARCHAR
                WHEN v IN (1, 3) THEN floor(bc / 100.0::DOUBLE)::BIGINT::VARCHAR ELSE 'N/A' END AS old_i,
           CASE WHEN v IN (0, 2, 6, 7) THEN lpad((oc % 100)::VARCHAR, 2, '0')
                WHEN v IN (1, 3)
                THEN lpad(trunc(((bc / 100.0::DOUBLE) % 1.0::DOUBLE) * 100.0::DOUBLE)::INTEGER::VARCHAR, 2, '0')
                ELSE 'N/A' END AS old_d,
           CASE WHEN v IN (0, 2, 6, 7) THEN oc WHEN v IN (1, 3)
                THEN (pc * 200 + 100 - pct) // (200 - 2 * pct) END AS typed_old,
           CASE WHEN v IN (1, 3) THEN pct WHEN v IN (0, 2, 6, 7) THEN dpct END AS dnum
    FROM (SELECT *, round_even((oc / 100.0::DOUBLE - pc / 100.0::DOUBLE) / (oc / 100.0::DOUBLE)
                               * 100.0::DOUBLE, 0)::INTEGER AS dpct,
                 CASE WHEN p - floor(p) = 0.5 AND e > 0 THEN ceil(p)
                      WHEN p - floor(p) = 0.5 AND e < 0 THEN floor(p)
                      ELSE round_even(p, 0) END::BIGINT AS bc
          FROM (SELECT *, (hi * 100.0::DOUBLE - p) + (x - hi) * 100.0::DOUBLE AS e
                FROM (SELECT *, x * 100.0::DOUBLE AS p,
                             x * 134217729.0::DOUBLE - (x * 134217729.0::DOUBLE - x) AS hi
                      FROM (SELECT *, {_X} AS x FROM ({SOURCE_SQL})))))"""

SHIPPING_SQL = "['UNKNOWN', 'BOTH', 'INTERNATIONAL_ONLY', 'OUT_OF_STOCK', 'NATIONAL'][k % 5 + 1]"
SIZES_SQL = """(CASE k % 5 WHEN 1 THEN 'Envio Nacional,International,' WHEN 2 THEN 'International,'
                WHEN 4 THEN 'Envio Nacional,' ELSE '' END) || 'S,M,' || p_size"""
SKU_SQL = "CASE WHEN k % 4 <> 3 THEN 'p' || k ELSE 'N/A' END"
REVIEWS_SQL = """CASE WHEN k % 3 = 0
         THEN left('4.' || (k % 10) || ' Review of every ' || p_type || ' item in this shop, sorted by date', 50)
         WHEN k % 3 = 1 AND k % 4 <> 3 THEN k || ' (12) ratings' ELSE 'N/A' END"""
_ABOUT = "CASE WHEN k % 2 = 0 THEN upper(left(a, 1)) || lower(substr(a, 2)) END"
_LOOSE = ("CASE WHEN k % 3 <> 2 THEN 'Loose text ' || (k % 5) || chr(10) || chr(10) || 'Size ' || p_size"
          " || chr(10) || chr(10) || 'Pack: no. ' || (k % 7) END")
_SPEC = "CASE WHEN k % 4 = 1 THEN 'Fabric: Cotton ' || p_type END"
_GOODS = "CASE WHEN k % 4 = 2 THEN 'Nice ' || p_type END"
DESCRIPTION_SQL = f"""
    SELECT url, coalesce(nullif(concat_ws(chr(10) || chr(10), {_ABOUT}, {_LOOSE}, {_SPEC}, {_GOODS}), ''),
                         'No description available') AS description, k, p_brand, p_type, p_size
    FROM (SELECT *, p_type || 'GOODSOF ' || p_brand AS a FROM ({SOURCE_SQL}))"""
ATTRIBUTES_SQL = f"""
    SELECT url, key, value FROM (
        SELECT url, unnest(['Brand', 'Type', 'Size', 'Pack']) AS key,
               unnest([p_brand, p_type, p_size::VARCHAR, 'no. ' || (k % 7)]) AS value
        FROM ({SOURCE_SQL}) WHERE k % 3 <> 2)"""
