"""Product extraction from hand-written pages."""

from __future__ import annotations

import random
from decimal import Decimal
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import triage
from shelfmark.operators import gate, markup, products
from shelfmark.operators.blocks import CONTRACT_LIMITS, SpecLimits
from shelfmark.operators.markup import ExtractConfig, PageNodes, candidates, parse_pages

JSON = '<script type="application/json">%s</script>'
RADIO = '<div class="product-intro__size-radio%s"%s>%s</div>'

DEFAULTS = dict(
    name="Unknown Product", product_name_safe="Unknown Product", sku="N/A", reviews="N/A",
    available_sizes=[], current_price_integer="0", current_price_decimal="00",
    old_price_integer="N/A", old_price_decimal="N/A", discount_percentage="N/A",
    description="No description available", is_international=False, current_price=None,
    old_price=None, discount_pct=None, shipping_status="UNKNOWN", _error=None)

PAGES = {
    "json prices": (
        '<h1 class="fsp-element">nice shirt</h1>'
        + JSON % '{"detail":{"promotionInfoPrice":{"amountWithSymbol":"$2.00"},'
                 '"x":[{"originalPrice":{"amountWithSymbol":"$2.20"}}]}}'
        + '<div class="productDiscountPercent">-9%</div>',
        dict(name="Nice Shirt", product_name_safe="Nice Shirt", current_price_integer="2",
             old_price_integer="2", old_price_decimal="20", discount_percentage="9%",
             current_price=Decimal("2.00"), old_price=Decimal("2.20"), discount_pct=9)),
    "markup prices": (
        '<div id="productMainPriceId">R$2.299,08</div>'
        '<p class="productEstimatedTagNewRetail__retail">R$2.999,00</p>',
        dict(current_price_integer="2299", current_price_decimal="08", old_price_integer="2999",
             old_price_decimal="00", discount_percentage="23%", discount_pct=23,
             current_price=Decimal("2299.08"), old_price=Decimal("2999.00"))),
    "computed old price": (
        '<div id="productMainPriceId">$17.99</div><div class="productDiscountPercent">10%</div>',
        dict(current_price_integer="17", current_price_decimal="99", old_price_integer="19",
             old_price_decimal="98", old_price=Decimal("19.99"), current_price=Decimal("17.99"), discount_percentage="10%",
             discount_pct=10)),
    "empty": ("<html><body></body></html>", {}),
    "no html": (None, {}),
    "number amount skipped": (
        JSON % '{"a":1}' + JSON % "{broken" + JSON % '{"detail":7}'
        + JSON % '{"promotionInfoPrice":{"amountWithSymbol":12.5}}'
        + JSON % '{"promotionInfoPrice":{"amountWithSymbol":"$3.10"}}',
        dict(current_price_integer="3", current_price_decimal="10", current_price=Decimal("3.10"))),
    "source key order": (
        JSON % '{"b":{"originalPrice":{"amountWithSymbol":"$9.00"}},'
               '"a":{"originalPrice":{"amountWithSymbol":"$8.00"}}}',
        dict(old_price_integer="9", old_price_decimal="00", old_price=Decimal("9.00"))),
    "sizes": (
        RADIO % ("", "", "S") + RADIO % ("", ' aria-label="M"', "x") + RADIO % ("", "", "S")
        + RADIO % (" product-intro__size-radio_soldout", "", "L"),
        dict(available_sizes=["S", "M"])),
    "both shipping": (
        RADIO % ("", ' aria-label="Envio Nacional"', "n") + RADIO % ("", ' aria-label="International"', "i"),
        dict(shipping_status="BOTH", available_sizes=["Envio Nacional", "International"])),
    "international only": (
        RADIO % ("", ' aria-label="International"', "i"),
        dict(shipping_status="INTERNATIONAL_ONLY", is_international=True,
             available_sizes=["International"])),
    "sold out": (
        RADIO % (" a_soldout", ' aria-label="Envio Nacional"', "n")
        + RADIO % (" b_soldout", ' aria-label="International"', "i"),
        dict(shipping_status="OUT_OF_STOCK")),
    "later shipping selector": (
        RADIO % ("", "", "S") + '<div class="my-Envio" aria-label="Envio Nacional">x</div>',
        dict(shipping_status="NATIONAL", available_sizes=["S"])),
    "sku": ("<script>SKU</script><div>SKU: sc1</div>", dict(sku="sc1")),
    "sku in comment": ("<div><!-- SKU --><b>x</b></div>", {}),
    "reviews": ('<div class="common-reviews">%s Review</div>' % ("4.9 " * 18),
                dict(reviews=("4.9 " * 18)[:50])),
    "reviews beside the sku": (
        "<div><p><span>SKU: q</span></p><p>plain</p><p>(7) stars</p></div>",
        dict(sku="q", reviews="(7) stars")),
    "broken markup": ('<h1>a<b>b</h1><p>x<p>y<script>var t="</p>"</script><div>',
                      dict(name="A B", product_name_safe="A B")),
    "entities": ("<h1>Tom &amp; Jerry&#39;s &eacute;t&eacute;</h1>",
                 dict(name="Tom & Jerry'S Été", product_name_safe="Tom & Jerry'S Été")),
}


@pytest.fixture(scope="module")
def extracted(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "url string, html string")
    rows = products.extract_products(df).collect()
    return {r["url"]: r.asDict() for r in rows}


@pytest.mark.parametrize("page", PAGES)
def test_page(extracted, page):
    got = extracted[page]
    want = {**DEFAULTS, **PAGES[page][1]}
    assert {k: got[k] for k in want} == want
    assert got["description_structured"]["text"] == got["description"]
    assert got["description_structured"]["attributes"] == {}


def blocks_of(spark, *pages):
    df = spark.createDataFrame([(n, page) for n, page in enumerate(pages)], "n int, html string")
    made = products.with_blocks(parse_pages(df, ("description",), keep=("n",)))
    return [r for r in made.orderBy("n").collect()]


def test_attributes_first_key_wins(spark):
    first = ('<div name="ProductIntroDescription"><dl><dt>Color</dt><dd>Red</dd></dl>'
             "<table><tr><td>Color</td><td>Blue</td></tr><tr><th>Material</th><td>Zinc</td></tr></table>"
             "<ul><li><b>Style:</b> Casual</li></ul><p>Element: Cartoon</p><script>bad: x</script></div>")
    parent = '<div name="ProductIntroDescription"><div>Details: <p>Color: Red</p><p>Fit: Slim</p></div></div>'
    one, two, none = blocks_of(spark, first, parent, "<p>Color: Red</p>")
    assert [(a["key"], a["value"]) for a in one["attrs"]] == [
        ("Color", "Red"), ("Material", "Zinc"), ("Style:", "Casual"), ("Element", "Cartoon")]
    assert one["frags"] == ["Style: Casual", "Element: Cartoon"]
    assert [(a["key"], a["value"]) for a in two["attrs"]] == [
        ("Details", "Color: Red Fit: Slim"), ("Color", "Red"), ("Fit", "Slim")]
    assert none["attrs"] == [] and none["frags"] == [] and none["specs"] == []


def test_spec_lines_skip_noise_and_stop_at_labels(spark):
    spec = ("<script>x = '<div class=\"common-entry__content\"><b>Fabric:</b><i>Cotton</i><i>pago 3</i>"
            "<i>soft</i><b>Fabric:</b><i>no</i><b>A:</b><i>short label</i><b>Care:</b></div>'</script>")
    assert blocks_of(spark, spec)[0]["specs"] == ["Fabric: Cotton soft", "Care: '"]


def plain_block(nodes):
    pairs, rest = {}, []
    for kind, label, text in nodes:
        tried = [(label, text)] if kind == "pair" else []
        if kind == "row":
            tried = [(label, text.replace(label, "", 1).strip() if label else "")]
            key, colon, said = text.partition(":")
            tried += [(key.strip(), said.strip())] if colon else []
        done = next(((k, v) for k, v in tried if k and v and k not in pairs), None)
        if done:
            pairs[done[0]] = done[1]
        elif kind != "pair":
            rest.append(text)
    return list(pairs.items()), [t for t in dict.fromkeys(rest) if t]


def plain_specs(texts, limits):
    lines, label, value, seen = {}, None, [], 0
    for t in [*texts, None]:
        head = t is not None and ":" in t and (limits.label_below is None or len(t) < limits.label_below)
        noisy = t is not None and any(w in t for w in limits.noise)
        if label is not None and t is not None and not head and (limits.lookahead is None or seen < limits.lookahead):
            seen += 1
            value += [] if noisy else [t]
            if noisy or limits.value_stop is None or len(" ".join(value)) <= limits.value_stop:
                continue
            lines[label], label, value = " ".join(value), None, []
            continue
        if label is not None and value:
            lines[label] = " ".join(value)
        label, value, seen = None, [], 0
        name = (t or "").replace(":", "").strip()
        if head and not noisy and name not in lines and len(name) > limits.label_above:
            label = name
    return [f"{k}: {v}" for k, v in lines.items()]


def test_folds_equal_plain_loops(spark):
    r = random.Random(11)
    word = lambda: r.choice(["Color", "Fit", "Red", "a b", "x", "", "Size:", "Fit: Slim", "Color: Red", "Note: a: b", ": z", "w" * 60, "pago", "S" * 55 + ":"])
    rows = []
    for n in range(300):
        nodes = []
        for _ in range(r.randrange(9)):
            label = r.choice(["", "Color", "Fit:", "Size"])
            kind = r.choice(["pair", "row", "row", "text"])
            text = (label + " " if kind == "row" else "") + " ".join(word() for _ in range(r.randrange(1, 4)))
            nodes.append((kind, label, text.strip()))
        rows.append((n, nodes, [[t for t in (word() for _ in range(r.randrange(14))) if t] for _ in range(r.randrange(3))]))
    df = spark.createDataFrame(rows, "n int, block array<struct<kind:string,label:string,text:string>>, spec_texts array<array<string>>")
    for limits in (CONTRACT_LIMITS, SpecLimits(), SpecLimits(lookahead=1), SpecLimits(value_stop=5, label_below=8)):
        for row in products.with_blocks(df, limits).collect():
            _, nodes, texts = rows[row["n"]]
            pairs, rest = plain_block(nodes)
            assert [(a["key"], a["value"]) for a in row["attrs"]] == pairs and row["frags"] == rest
            assert row["specs"] == list(dict.fromkeys(x for t in texts for x in plain_specs(t, limits)))


def test_whole_texts_beside_the_short_ones(spark):
    name, review = "Long " * 40 + "Name", "Reviews (12) " + "very good " * 30
    page = f'<h1>{name}</h1><div id="productMainPriceId">$5.00</div><div class="common-reviews">{review}</div>'
    row = products.extract_products(spark.createDataFrame([("u", page)], "url string, html string")).first()
    assert len(row["name"]) <= 80 and row["name_whole"] == name and row["reviews_whole"] == review.strip()
    assert row["reviews"] == review[:50]


def test_goods_desc_every_script_and_first_string(spark):
    page = ('<script>{"goods_desc":""}</script>'
            '<script>{"goods_desc":{"x":1},"y":[{"goods_desc":"<b>one</b> two"}]}</script>'
            '<script>{"goods_desc":"three"}</script><script>goods_desc = "no json"</script>')
    row = candidates(page, ("description",), ExtractConfig())
    assert row["goods_desc"] == ["<b>one</b> two", "three"]
    df = spark.createDataFrame([("u", page)], "url string, html string")
    assert products.extract_fields(df, "description").first()["description"] == "one two\n\nthree"


def test_price_search_at_any_depth():
    def nested(levels):
        return JSON % ('{"a":' * levels + '{"originalPrice":{"amountWithSymbol":"$5.00"}}' + "}" * levels)
    for levels in (1, 15, 16, 400):
        assert candidates(nested(levels), ("price",), ExtractConfig())["old_json"] == ["$5.00"]


def test_strict_tokens_and_shipping_switch(spark):
    html = (RADIO % ("", "", "S") + RADIO % (" product-intro__size-radio_soldout", "", "L")
            + RADIO % ("", ' aria-label="International"', "i"))
    df = spark.createDataFrame([("u", html)], "url string, html string")
    sizes = {s: products.extract_products(df, strict_tokens=s, exclude_shipping=s).first()["available_sizes"]
             for s in (False, True)}
    assert sizes == {False: ["S", "International"], True: ["S", "L"]}


def test_own_selectors(spark):
    df = spark.createDataFrame([("u", '<p id="t">my thing</p><h1>other</h1>')], "url string, html string")
    config = ExtractConfig(name=[("p", "id", "is", "t")])
    assert products.extract_fields(df, "name", config=config).first()["name"] == "My Thing"


def test_page_kinds(spark):
    rows = [("https://s.example/a-p-1.html", "<h1>Please verify</h1> slide to complete", "blocked"),
            ("https://s.example/captcha?x=1", "add to bag price sku", "blocked"),
            ("https://s.example/user/auth/login?r=1", "add to bag price sku", "login"),
            ("https://s.example/a-p-1.html", "ADD TO BAG price", "product"),
            ("https://s.example/a-p-1.html", "price only", "other"),
            (None, None, "other")]
    df = spark.createDataFrame(rows, "url string, html string, kind string")
    kind = triage.page_kind(F.col("url"), F.lower("html"))
    assert all(r["kind"] == r["got"] for r in df.select("kind", kind.alias("got")).collect())


def test_gate(spark):
    rows = [("ok", "5", None), (" Unknown Product ", "5", "invalid_name"), (None, "5", "invalid_name"),
            ("ok", "0", "invalid_price"), ("ok", " ", "invalid_price"), ("N/A", "0", "invalid_name")]
    df = spark.createDataFrame(rows, "name string, current_price_integer string, want string")
    for r in df.select("want", gate.reject_reason().alias("got")).collect():
        assert r["want"] == r["got"]
    assert gate.valid_products(df).count() == 1


def test_summary_and_card(spark):
    df = spark.createDataFrame([("u", PAGES["json prices"][0])], "url string, html string")
    got = products.extract_products(df).select(products.summary().alias("s"), products.card().alias("c")).first()
    assert got["s"] == ("Nice Shirt | N/A | N/A |  | R$2,20 | R$2,00 | 9% | No description available...")
    assert got["c"].startswith("Product Name: Nice Shirt\n\nPrice: From R$2,00 to R$2,20 (9%)\n\n")


def test_links_of_odd_markup():
    html = ('<a href="/x-p-1.html">1</a><A HREF=/x-p-2.html>2<a href="/y">no</a><a href>none</a><a name="n">'
            '<a href="/first-p-0" href="/x&amp;y-p-3?a=1&b=2"/><!-- <a href="/c-p-4"> -->'
            '<script>"<a href=\'/s-p-5\'>"</script><p><a href=\'/q-p-6')
    row = candidates(html, ("links",), ExtractConfig())
    assert row["links"] == ["/x-p-1.html", "/x-p-2.html", "/x&y-p-3?a=1&b=2"]
    assert candidates(html, ("links", "name"), ExtractConfig())["links"] == row["links"]


TYPED = {
    ("R$2.299,08", "R$2.999,00", ""): ("2299.08", "2999.00", 23),
    ("R$49,90", "R$59,90", ""): ("49.90", "59.90", 17),
    ("R$1.299,00", "", "20%"): ("1299.00", "1623.75", 20),
    ("$1,234.56", "", "-20%"): ("1234.56", "1543.20", 20),
    ("$70.00", "", "-12.5%"): ("70.00", "80.00", 12),
    ("$999.00", "$1,234.56", ""): ("999.00", "1234.56", 19),
    ("$1,234,567.89", "", ""): ("1234567.89", None, None),
}


def test_typed_prices_settle_their_own_separators(spark):
    from decimal import Decimal
    page = '<div id="productMainPriceId">%s</div><del>%s</del><span class="x-discount">%s</span>'
    df = spark.createDataFrame([(str(n), page % k) for n, k in enumerate(TYPED)], "url string, html string")
    got = {r["url"]: r for r in products.extract_products(df).collect()}
    for n, (current, old, off) in enumerate(TYPED.values()):
        row = got[str(n)]
        assert row["current_price"] == Decimal(current)
        assert row["old_price"] == (Decimal(old) if old else None)
        assert row["discount_pct"] == off


def test_heavy_rows_are_dealt_to_all_cores(spark, tmp_path):
    """Files of few row groups leave most splits empty."""
    from shelfmark.catalogue import QUERIES
    part = spark.createDataFrame([(n, "t", "n", "b") for n in range(400)], "p_partkey long, p_type string, p_name string, p_brand string")
    docs = spark.createDataFrame([(n, "some text") for n in range(400)], "doc_id long, text string")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for n in range(60):  # as many splits as cores, nearly all rows in one
        (docs if n == 0 else docs.limit(0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    cores = spark.sparkContext.defaultParallelism
    for name in ("spec_lines_whole", "name_normalize"):
        at = QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct()
        assert at.count() >= cores, name


class LibraryNodes(PageNodes):
    """The nodes by the library's own loop alone."""
    goahead = HTMLParser.goahead


BITS = ["<", ">", "</", "/>", '"', " ", "&", "&amp;", "&#65;", "<script>", "</script>", "</ script>", "</SCRIPT >", "</scriptx>", "<style>",
        "</style>", "<!--", "-->", "<![CDATA[", "]]>", "<?pi ?>", "<!doctype x>", "<title>", "</title>", "<br/>", "<br>", "<p class=a>", "<DIV  ID=\"X\" a>",
        '<p class="a b" class="c" disabled>', "</DIV >", "</>", '<a href="?a=1&b=2">', "\n", "\x00", "é", "<h1>", "</h1>", "<x-y z>", "text",
        '<p id="a>b" title="x<y">', "<1", "<![bad[x]]>", '<span class="price-current">', "</span>", "</p>", "SKU: 1"]


def test_short_way_builds_the_same_nodes():
    def nodes(kind, html):
        try:
            page = kind(html)
        except Exception as broken:
            return repr(broken)
        return page.tag, page.attr, page.up, page.end, page.at, page.raw, page.shown, page.trimmed
    rnd = random.Random(3)
    made = ["".join(rnd.choices(BITS, k=rnd.randint(1, 14))) for _ in range(4000)]
    for html in [*made, *(p[0] for p in PAGES.values()), ""]:
        assert nodes(PageNodes, html) == nodes(LibraryNodes, html), html


def test_plain_tags_take_the_short_way(monkeypatch):
    def refuse(self, i):
        raise AssertionError("the library's method was called")
    for name in ("parse_starttag", "parse_endtag"):
        monkeypatch.setattr(HTMLParser, name, refuse)
    page = PageNodes('<body><div class="a b" id="x"><p>one &amp; two</p><br></div></body>')
    assert page.text(0) == "one & two" and page.by_tag == {"body": [1], "div": [2], "p": [3], "br": [5]}


def test_remembered_attributes_stay_bounded():
    for n in range(2 * markup._MOST):
        list(PageNodes(f'<p class="c{n}">').select(("p", "class", "like", "c")))
    assert len(markup._ATTRS) <= markup._MOST and len(markup._SEEN) <= markup._MOST


def test_triage_lowers_a_page_once(spark):
    pages = spark.createDataFrame([(1, "u", "<p>SKU PRICE</p>"), (2, "u", None), (3, "captcha", "sku price")], "page_id long, url string, html string")
    kept = triage.product_pages(pages)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(html#") == 1
    assert [r["page_id"] for r in kept.collect()] == [1]


def test_names_are_cleaned_once_for_both_lengths(spark):
    long = "big blue, shirt " * 8
    df = spark.createDataFrame([([None, "", long, "b"],), ([None, ""],), (None,)], "name_c array<string>")
    named = products.with_name(df).select("name", "name_whole")
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("initcap(") == 1
    whole = "Big Blue Shirt " * 8
    assert [tuple(r) for r in named.collect()] == [
        ("Big Blue Shirt Big Blue Shirt Big Blue Shirt Big Blue Shirt Big Blue Shirt Big", whole.strip()),
        ("Unknown Product", None), ("Unknown Product", None)]
