"""Product rules over the candidate columns of ``markup.parse_pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import fixed_values as fixed
from shelfmark.functions import money, names
from shelfmark.functions.text import blank_to_null, strip, upper_first
from shelfmark.operators.blocks import CONTRACT_LIMITS, SpecLimits, attribute_pairs, block_content, free_text, spec_lines
from shelfmark.operators.markup import PRODUCT_FIELDS, ExtractConfig, parse_pages
from shelfmark.schema import EXTRA_COLUMNS, PRODUCT_COLUMNS


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def with_name(df: DataFrame) -> DataFrame:
    """``name`` from the first selector whose cleaned text is not empty; ``name_whole`` is not cut."""
    # cleaned once for both lengths; selectors that found no text are left out first
    texts = F.filter("name_c", lambda t: t.isNotNull() & (t != ""))
    df = df.withColumn("_names", F.transform(texts, lambda t: names.clean_name(t)))
    df = df.withColumn("name", F.coalesce(_first(F.transform("_names", lambda t: names.cut_name(t))), F.lit(fixed.UNKNOWN_NAME)))
    df = df.withColumn("name_whole", _first(F.transform("_names", lambda t: names.cut_name(t, None))))
    return df.withColumn("product_name_safe", names.safe_name(F.col("name"))).drop("_names")


def with_prices(df: DataFrame, locale: str | None = None) -> DataFrame:
    """Current price, discount and old price, each with its own fallbacks.

    The text columns keep the contract to the letter; ``current_price``,
    ``old_price`` and ``discount_pct`` come from whole texts and exact percents
    alone. ``locale`` fixes their separators, else each text settles its own.

    Order matters: the discount may be computed from both prices, but an old
    price that is itself computed from the discount never feeds back into it.
    """
    df = (df.withColumn("_cur", money.first_price(F.concat("cur_json", "cur_c")))
          .withColumn("_old", money.first_price(F.concat("old_json", "old_c")))
          .withColumn("_shown", _first(F.transform("disc_c", money.percent_text))))
    old_int, old_dec = money.whole_part(F.col("_old.found")), money.cents_part(F.col("_old.found"))
    cur_int = F.coalesce(money.whole_part(F.col("_cur.found")), F.lit(fixed.NO_PRICE[0]))
    cur_dec = F.coalesce(money.cents_part(F.col("_cur.found")), F.lit(fixed.NO_PRICE[1]))
    df = (df.withColumn("current_price_integer", cur_int)
          .withColumn("current_price_decimal", cur_dec)
          .withColumn("_now", F.when(cur_int != fixed.NO_PRICE[0],
                                     money.joined_amount(cur_int, cur_dec)))
          .withColumn("_was", money.joined_amount(old_int, old_dec)))
    df = df.withColumn("_computed", F.when(F.col("_was") > 0, money.percent_off(
        F.col("_was"), F.col("_now"))))
    df = df.withColumn("discount_percentage", F.coalesce(
        F.col("_shown"), F.concat(F.col("_computed").cast("string"), F.lit("%")),
        F.lit(fixed.MISSING)))
    percent = money.percent_value(F.col("discount_percentage"))
    df = df.withColumn("_prior", F.when(F.col("_old").isNull(),
                                        money.price_before(F.col("_now"), percent)))
    df = df.withColumn("_before", money.cents(F.col("_prior")))
    shown = _first_known(F.transform("disc_c", money.exact_percent))
    df = (df
          .withColumn("old_price_integer", F.coalesce(
              old_int, money.cents_integer(F.col("_before")),
              F.lit(fixed.MISSING)))
          .withColumn("old_price_decimal", F.coalesce(
              old_dec, money.cents_decimal(F.col("_before")),
              F.lit(fixed.MISSING)))
          .withColumn("current_price", money.amount(F.col("_cur.text"), locale))
          .withColumn("_typed", money.amount(F.col("_old.text"), locale)))
    off = F.when(F.col("_typed") > 0, money.percent_off(F.col("_typed").cast("double"),
                                                        F.col("current_price").cast("double")))
    return (df
            .withColumn("old_price", F.coalesce("_typed", money.amount_before(F.col("current_price"), shown)))
            .withColumn("discount_pct", F.coalesce(F.rint(shown.cast("double")).cast("int"), off))
            .drop("_cur", "_old", "_shown", "_computed", "_now", "_was", "_prior", "_before", "_typed"))


def _first_known(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def goods_text(raw: Column) -> Column:
    """Shop text blocks without their tags, blanks dropped."""
    bare = F.transform(raw, lambda t: strip(F.regexp_replace(t, "<[^>]+>", "")))
    return F.filter(bare, lambda t: t != "")


def with_blocks(df: DataFrame, limits: SpecLimits = CONTRACT_LIMITS) -> DataFrame:
    """``attrs``, ``frags`` and ``specs`` from the nodes that the mapper found."""
    df = df.withColumn("_content", block_content(F.coalesce("block", F.array().cast(df.schema["block"].dataType))))
    return (df.withColumn("attrs", attribute_pairs(F.col("_content"))).withColumn("frags", free_text(F.col("_content")))
            .withColumn("specs", spec_lines(F.coalesce("spec_texts", F.array().cast("array<array<string>>")), limits))
            .drop("_content", "block", "spec_texts"))


def with_description(df: DataFrame, limits: SpecLimits = CONTRACT_LIMITS) -> DataFrame:
    df = with_blocks(df, limits)
    blocks = F.concat(
        F.array(F.when(F.col("desc_c") != "", upper_first(F.col("desc_c"))),
                strip(F.array_join("frags", "\n\n")),
                F.array_join("specs", "\n")),
        goods_text(F.col("goods_desc")))
    whole = F.array_distinct(F.filter(blocks, lambda t: t.isNotNull() & (t != "")))
    df = df.withColumn("_text", blank_to_null(strip(F.array_join(whole, "\n\n"))))
    empty = F.expr("map_from_arrays(CAST(array() AS array<string>), CAST(array() AS array<string>))")
    attributes = F.when(F.col("_text").isNotNull() & F.col("_error").isNull(),
                        F.map_from_entries("attrs")).otherwise(empty)
    df = df.withColumn("description", F.coalesce("_text", F.lit(fixed.NO_DESCRIPTION)))
    return df.withColumn("description_structured", F.struct(
        F.col("description").alias("text"), attributes.alias("attributes"))).drop("_text")


def _verdict(options: Column) -> Column:
    """Shipping verdict of one selector's options; NULL leaves it to the next."""
    def any_option(label: str, sold_out: bool) -> Column:
        def test(o: Column) -> Column:
            out = F.exists(o["classes"], lambda c: F.contains(c, F.lit(fixed.SHIPPING_SOLD_OUT)))
            return (o["aria"] == label) & (out if sold_out else ~out)
        return F.exists(options, test)

    national = any_option(fixed.NATIONAL_LABEL, False)
    abroad = any_option(fixed.INTERNATIONAL_LABEL, False)
    national_gone = any_option(fixed.NATIONAL_LABEL, True)
    abroad_gone = any_option(fixed.INTERNATIONAL_LABEL, True)
    return (F.when(abroad & ~national, F.lit("INTERNATIONAL_ONLY"))
            .when(abroad & national, F.lit("BOTH"))
            .when((national_gone | ~national) & (national_gone | abroad_gone), F.lit("OUT_OF_STOCK"))
            .when(national, F.lit("NATIONAL")))


def with_shipping(df: DataFrame) -> DataFrame:
    verdicts = F.filter(F.transform("ship", _verdict), lambda v: v.isNotNull())
    df = df.withColumn("shipping_status", F.coalesce(F.get(verdicts, F.lit(0)), F.lit("UNKNOWN")))
    return df.withColumn("is_international", F.col("shipping_status") == "INTERNATIONAL_ONLY")


def with_sizes(df: DataFrame, strict_tokens: bool = False,
               exclude_shipping: bool = False) -> DataFrame:
    """Sizes on offer, in page order, each once.

    Sold-out elements are left out. ``strict_tokens`` tests class by class, so
    one class without the sold-out mark is enough to keep an element.
    """
    def on_offer(e: Column) -> Column:
        def kept(c: Column) -> Column:
            return ~F.contains(c, F.lit(fixed.SOLD_OUT))
        if strict_tokens:
            return F.exists(e["classes"], lambda c: F.contains(c, F.lit(fixed.SIZE_CLASS)) & kept(c))
        return F.forall(e["classes"], kept)

    labels = F.transform(F.filter("sizes_el", on_offer),
                         lambda e: F.coalesce(blank_to_null(e["aria"]), e["text"]))
    labels = F.filter(labels, lambda t: t != "")
    if exclude_shipping:
        labels = F.filter(labels, lambda t: ~t.isin(fixed.NATIONAL_LABEL, fixed.INTERNATIONAL_LABEL))
    return df.withColumn("available_sizes", F.array_distinct(labels))


def with_sku(df: DataFrame) -> DataFrame:
    found = F.when(F.contains("sku_c", F.lit("SKU")),
                   strip(F.translate(F.replace("sku_c", F.lit("SKU"), F.lit("")), ":", "")))
    return df.withColumn("sku", F.coalesce(found, F.lit(fixed.MISSING)))


def with_reviews(df: DataFrame, length: int = fixed.REVIEW_LENGTH) -> DataFrame:
    """``reviews`` as the contract cuts it, ``reviews_whole`` uncut and NULL where there is none."""
    own = F.when(F.rlike("review_c", F.lit(r"[Rr]eview|\(")), F.col("review_c"))
    text = F.coalesce(own, F.col("review_sib"))
    return (df.withColumn("reviews", F.coalesce(F.left(text, F.lit(length)), F.lit(fixed.MISSING)))
            .withColumn("reviews_whole", text))


def _limits(config: ExtractConfig | None) -> SpecLimits:
    return (config or ExtractConfig()).spec


_STEPS = {"name": with_name, "price": with_prices, "description": with_description,
          "shipping": with_shipping, "sizes": with_sizes, "sku": with_sku,
          "reviews": with_reviews}


def extract_fields(pages: DataFrame, *fields: str, keep: tuple[str, ...] = ("url",),
                   html: str = "html", config: ExtractConfig | None = None) -> DataFrame:
    """Parse once and add only the product columns of the named fields."""
    df = parse_pages(pages, fields, keep=keep, html=html, config=config)
    for name in fields:
        df = _STEPS[name](df, _limits(config)) if name == "description" else _STEPS[name](df)
    return df


def extract_products(pages: DataFrame, *, keep: tuple[str, ...] = (),
                     config: ExtractConfig | None = None, locale: str | None = None,
                     strict_tokens: bool = False, exclude_shipping: bool = False) -> DataFrame:
    """Product records in contract order, typed companions, ``_error``.

    Rows whose page could not be parsed stay, with the reason in ``_error``.
    """
    df = parse_pages(pages, PRODUCT_FIELDS, keep=("url", *keep), config=config)
    df = with_description(with_prices(with_name(df), locale), _limits(config))
    df = with_shipping(with_sizes(df, strict_tokens, exclude_shipping))
    df = with_reviews(with_sku(df))
    return df.select(*PRODUCT_COLUMNS, *EXTRA_COLUMNS, *keep, "_error")


def summary(length: int | None = fixed.SUMMARY_LENGTH) -> Column:
    """One printable line per product; without a length the description is whole."""
    old = F.when(F.col("old_price_integer") != fixed.MISSING,
                 F.col("old_price_decimal")).otherwise(F.lit(fixed.MISSING))
    return F.format_string(
        "%s | %s | %s | %s | R$%s,%s | R$%s,%s | %s | %s...",
        F.col("name"), F.col("sku"), F.col("reviews"), F.array_join("available_sizes", ", "),
        F.col("old_price_integer"), old, F.col("current_price_integer"),
        F.col("current_price_decimal"), F.col("discount_percentage"),
        F.col("description") if length is None else F.left("description", F.lit(length)))


def card(call: str = "Find it online:") -> Column:
    """The product text card."""
    def price(kind: str) -> Column:
        return F.concat(F.col(f"{kind}_price_integer"), F.lit(","), F.col(f"{kind}_price_decimal"))
    return F.format_string(fixed.CARD_TEMPLATE, F.col("name"), price("current"), price("old"),
                           F.col("discount_percentage"), F.col("description"), F.lit(call),
                           F.col("url"))
