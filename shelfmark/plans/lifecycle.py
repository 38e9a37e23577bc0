"""The three jobs a user runs: clean a list, discover links, scrape pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.operators import discovery, gate, store, urllists
from shelfmark.functions import triage
from shelfmark.operators.markup import ExtractConfig
from shelfmark.operators.products import extract_products
from shelfmark.session import checkpointed


def clean_list(lines: DataFrame, rule: str = "recommended") -> DataFrame:
    """``distinct``, ``ordered`` or ``recommended`` cleaning of raw lines."""
    rules = {"distinct": urllists.clean_distinct, "ordered": urllists.clean_ordered,
             "recommended": urllists.clean_recommended}
    return rules[rule](lines)


def discover_urls(pages: DataFrame, origin: str, *, seed: DataFrame | None = None,
                  max_urls: int | None = None, pattern: str | None = None,
                  blocked: list[str] | None = None, failed_path: str | None = None) -> DataFrame:
    """Listing pages (cat_idx, page_num, page_url, html) to the collected URLs.

    Pages that could not be parsed are neither empty nor new; ``failed_path``
    gets their (cat_idx, page_num, error).
    """
    marked = discovery.mark_blocked(pages, *([] if blocked is None else [blocked]))
    options = {} if pattern is None else {"pattern": pattern}
    parsed = checkpointed(discovery.parse_links(marked.where(~F.col("blocked")), origin, **options))
    if failed_path is not None:
        (parsed.where(F.col("error").isNotNull()).select(*discovery.PAGE, "error")
         .write.mode("append").parquet(failed_path))
    marked = discovery.mark_failed(marked.drop("html"), parsed)
    links = parsed.select(*discovery.PAGE, F.explode("links").alias("url"))
    found = discovery.discover(marked, links, seed=seed, max_urls=max_urls).select("url")
    return found if seed is None else found.union(seed.select("url").distinct())


def scrape(work: DataFrame, pages: DataFrame, stored: DataFrame, *, seq: str = "page_id",
           target: int = 0, triage_pages: bool = True,
           config: ExtractConfig | None = None, locale: str | None = None,
           failed_path: str | None = None) -> DataFrame:
    """Products to append for a work list (url, line).

    Everything that makes less work comes first: done URLs are removed, the
    target is cut, pages are picked and triaged, and only then is HTML parsed.
    Page text is read once; duplicates are settled on the narrow records, so
    the first page of a URL that yields a valid product wins. Pages that could
    not be parsed are appended to ``failed_path`` as (url, seq, error).
    """
    todo = store.limit_work(store.remaining(work, stored), target)
    mine = store.keep_listed(pages, todo)
    if triage_pages:
        mine = triage.product_pages(mine)
    made = extract_products(mine, keep=(seq,), config=config, locale=locale)
    if failed_path is not None:
        gate.failed_pages(made, seq).write.mode("append").parquet(failed_path)
    good = gate.valid_products(made.where(F.col("_error").isNull())).drop("_error")
    return store.absent(good, stored, seq).drop(seq)
