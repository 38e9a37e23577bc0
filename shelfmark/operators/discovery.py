"""Link discovery over landed listing pages.

Pages are visited category by category and page by page. A link is new on the
first visited page that shows it; a category ends after a streak of pages
without news; a cap ends the whole run, checked before each page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import fixed_values as fixed
from shelfmark.functions import triage, urls
from shelfmark.operators.markup import ExtractConfig, parse_pages
from shelfmark.operators.series import range_chunk, running, since_last
from shelfmark.session import checkpointed

PAGE = ["cat_idx", "page_num"]


def mark_blocked(pages: DataFrame, patterns: list[str] = fixed.LISTING_BLOCK_PATTERNS) -> DataFrame:
    return pages.withColumn("blocked", triage.url_blocked(F.col("page_url"), patterns))


def parse_links(pages: DataFrame, origin: str, *, keep: tuple[str, ...] = tuple(PAGE),
                pattern: str = fixed.PRODUCT_LINK, resolve: bool = False) -> DataFrame:
    """``keep``, links and error: one row per page, links NULL where it could not be parsed."""
    found = parse_pages(pages, ("links",), keep=keep,
                        config=ExtractConfig(link_pattern=pattern))

    def clean(href: Column) -> Column:
        return urls.absolute(urls.canonical(href), origin, resolve)

    # one page is one row here, so array_distinct replaces a shuffle
    links = F.array_distinct(F.transform("links", clean))
    return found.select(*keep, links.alias("links"), F.col("_error").alias("error"))


def extract_links(pages: DataFrame, origin: str, *, keep: tuple[str, ...] = tuple(PAGE),
                  pattern: str = fixed.PRODUCT_LINK, resolve: bool = False) -> DataFrame:
    """``keep`` + url: canonical absolute product links, distinct per page."""
    found = parse_links(pages, origin, keep=keep, pattern=pattern, resolve=resolve)
    return found.select(*keep, F.explode("links").alias("url"))


def mark_failed(marked: DataFrame, parsed: DataFrame) -> DataFrame:
    """Pages that could not be parsed count as blocked: neither empty nor new."""
    failed = parsed.where(F.col("error").isNotNull()).select(*PAGE, F.lit(True).alias("_failed"))
    return (marked.join(failed, PAGE, "left")
            .withColumn("blocked", F.col("blocked") | F.coalesce("_failed", F.lit(False))).drop("_failed"))


def first_seen(links: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """url with the first (cat_idx, page_num) that shows it, seed URLs left out.

    ``min`` over the packed page position is a hash aggregate that combines on
    the map side, so a link that sits on every page costs one row per task.
    """
    packed = F.shiftleft(F.col("cat_idx").cast("bigint"), 32) + F.col("page_num")
    first = links.groupBy("url").agg(F.min(packed).alias("p")).select(
        "url", F.shiftright("p", 32).cast("int").alias("cat_idx"),
        F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)).cast(links.schema["page_num"].dataType)
        .alias("page_num"))
    return first if seed is None else first.join(seed.select("url"), "url", "left_anti")


def new_per_page(pages: DataFrame, new_links: DataFrame) -> DataFrame:
    """Pages with their number of new links, 0 kept."""
    counts = new_links.groupBy(*PAGE).agg(F.count("*").alias("new_urls"))
    return (pages.join(counts, PAGE, "left")
            .withColumn("new_urls", F.coalesce("new_urls", F.lit(0)).cast("bigint")))


def stop_pages(counted: DataFrame, streak: int = fixed.EMPTY_PAGE_STREAK) -> DataFrame:
    """cat_idx, stop_page: where ``streak`` pages in a row had no news.

    Blocked pages neither count nor reset. Only categories that reach the
    streak appear.
    """
    pages = (counted.where(~F.col("blocked"))
             .select("cat_idx", "page_num", "new_urls", range_chunk("page_num").alias("_chunk")))
    pages = since_last(pages, ["cat_idx"], "_chunk", ["page_num"],
                       reset=F.col("new_urls") > 0, name="_empty")
    return (pages.where(F.col("_empty") >= streak)
            .groupBy("cat_idx").agg(F.min("page_num").alias("stop_page")))


def visited_pages(counted: DataFrame, streak: int = fixed.EMPTY_PAGE_STREAK) -> DataFrame:
    stops = stop_pages(counted, streak)
    joined = counted.join(stops, "cat_idx", "left")
    return joined.where(F.col("stop_page").isNull() | (F.col("page_num") <= F.col("stop_page")))


def cap_pages(counted: DataFrame, max_urls: int, seeded: int = 0) -> DataFrame:
    """Pages visited before ``max_urls`` were collected.

    The total is looked at before each page, so the last page may overshoot.
    """
    chunked = counted.withColumn("_chunk", F.struct(
        F.col("cat_idx"), range_chunk("page_num").alias("part")))
    totalled = running(chunked, [], "_chunk", PAGE, before=True,
                       sums={"collected_before": F.col("new_urls")})
    return (totalled.withColumn("collected_before", F.col("collected_before") + F.lit(seeded))
            .where(F.col("collected_before") < max_urls).drop("_chunk"))


def discover(pages: DataFrame, links: DataFrame, *, seed: DataFrame | None = None,
             max_urls: int | None = None, streak: int = fixed.EMPTY_PAGE_STREAK) -> DataFrame:
    """url, cat_idx, page_num of every link the visited pages bring in.

    ``pages`` has cat_idx, page_num, blocked. A page behind the stop page of
    its category must not use up a link for a later category, so what is new
    depends on the stops and the stops on what is new. All categories are
    solved at once, again and again, with the stops of the round before: each
    round settles at least one more category, and usually two or three rounds
    settle all. Only one stop number per category reaches the driver.
    """
    pages = pages.select(*PAGE, "blocked")
    open_links = links.join(pages.where("blocked"), PAGE, "left_anti")
    if seed is not None:
        open_links = open_links.join(seed.select("url").distinct(), "url", "left_anti")
    # one entry per link and category, however often the category shows it, and
    # one row per link: the rounds need no further shuffle of the links
    shown = open_links.groupBy("url", "cat_idx").agg(F.min("page_num").alias("page_num"))
    shown = checkpointed(shown.groupBy("url").agg(
        F.sort_array(F.collect_list(F.struct(*PAGE))).alias("shown")))
    pages = checkpointed(pages)

    stops: dict[int, int] = {}
    while True:
        new_links = _new_given_stops(shown, stops)
        counted = new_per_page(pages, new_links)
        found = {r["cat_idx"]: r["stop_page"] for r in stop_pages(counted, streak).collect()}
        if found == stops:
            break
        stops = found

    reached = _reached(stops, F.col("cat_idx"), F.col("page_num"))
    visited = counted.where(reached)
    if max_urls is not None:
        seeded = 0 if seed is None else seed.select("url").distinct().count()
        visited = cap_pages(visited, max_urls, seeded)
    return new_links.where(reached).join(visited.select(*PAGE), PAGE, "left_semi")


def _reached(stops: dict[int, int], cat_idx: Column, page_num: Column) -> Column:
    """Is the page at or before the stop of its category?"""
    if not stops:
        return F.lit(True)
    table = F.create_map(*[F.lit(x) for pair in stops.items() for x in pair])
    return F.coalesce(page_num <= F.try_element_at(table, cat_idx), F.lit(True))


def _new_given_stops(shown: DataFrame, stops: dict[int, int]) -> DataFrame:
    """Link and page where no earlier category shows the link on a visited page."""
    def visited(e: Column) -> Column:
        return _reached(stops, e["cat_idx"], e["page_num"])

    # Up to the first visited page, that one included; one pass over a link's pages.
    first = F.array_position(F.transform("shown", visited), F.lit(True))
    new = F.when(first > 0, F.slice("shown", F.lit(1), first.cast("int"))).otherwise(F.col("shown"))
    return shown.select("url", F.inline(new))


def select_categories(choices: DataFrame, dim: DataFrame, choice: str = "choice",
                      all_word: bool = False) -> DataFrame:
    """Selections such as ``1,3`` to category rows, in order, repeats kept.

    Unknown numbers are dropped; anything that is no number empties the whole
    selection. ``all_word`` lets the word ``all`` stand for every category.
    """
    text = F.col(choice)
    ids = F.transform(F.split(text, ","), lambda t: F.trim(t).try_cast("int"))
    if all_word:
        every = dim.agg(F.sort_array(F.collect_list("category_id"))).scalar()
        ids = F.when(F.lower(F.trim(text)) == "all", every).otherwise(ids)
    valid = choices.withColumn("_ids", ids).where(~F.exists("_ids", lambda i: i.isNull()))
    numbered = valid.select(*choices.columns, F.posexplode("_ids").alias("pos", "category_id"))
    return numbered.join(dim, "category_id")
