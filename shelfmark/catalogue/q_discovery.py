"""Listing pages, categories and page triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import fixed_values as fixed
from shelfmark.catalogue import inputs as i
from shelfmark.catalogue.registry import query
from shelfmark.functions import triage
from shelfmark.functions.text import words_found
from shelfmark.operators import discovery as d
from shelfmark.plans import lifecycle
from shelfmark.sources.categories import category_dim

# Caps that fall inside the data from scale 0.01 on; the second counts the seed.
MAX_NEW = 60
MAX_URLS = 175


def _pages(t):
    return d.mark_blocked(i.listing_pages(t), i.LISTING_BLOCKED)


def _links(t):
    return d.extract_links(_pages(t).where(~F.col("blocked")), i.ORIGIN, pattern="/")


def _seed(t):
    """Links of the last language count as collected by an earlier run."""
    last = i.listing_pages(t).where(F.col("cat_idx") == len(i.LANGUAGES))
    return d.extract_links(last, i.ORIGIN, pattern="/").select("url").distinct()


_SEED = f"SELECT DISTINCT url FROM ({i.ALL_LINKS_SQL}) WHERE cat_idx = {len(i.LANGUAGES)}"
_FIRST = f"""
    SELECT url, cat_idx, page_num
    FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY cat_idx, page_num) AS rn
          FROM ({i.LINKS_SQL}) WHERE url NOT IN ({_SEED}))
    WHERE rn = 1"""
_COUNTED = f"""
    SELECT p.cat_idx, p.page_num, p.blocked, count(f.url) AS new_urls
    FROM ({i.PAGES_SQL}) p LEFT JOIN ({_FIRST}) f USING (cat_idx, page_num)
    GROUP BY p.cat_idx, p.page_num, p.blocked"""
_STOPS = f"""
    SELECT cat_idx, min(page_num) AS stop_page
    FROM (SELECT *, sum(CASE WHEN new_urls = 0 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY cat_idx, island ORDER BY page_num) AS zeros
          FROM (SELECT *, sum(CASE WHEN new_urls > 0 THEN 1 ELSE 0 END)
                       OVER (PARTITION BY cat_idx ORDER BY page_num) AS island
                FROM ({_COUNTED}) WHERE NOT blocked))
    WHERE zeros = 3 GROUP BY cat_idx"""
_CAPPED = f"""
    SELECT cat_idx, page_num, blocked, new_urls, collected_before
    FROM (SELECT *, (coalesce(sum(new_urls) OVER (ORDER BY cat_idx, page_num
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS collected_before
          FROM ({_COUNTED}))
    WHERE collected_before < {MAX_NEW}"""


def _counted(t):
    return d.new_per_page(_pages(t).drop("html", "page_url"), d.first_seen(_links(t), _seed(t)))


@query("links_extract", i.LINKS_SQL)
def links_extract(t):
    return _links(t)


@query("links_first_seen", _FIRST)
def links_first_seen(t):
    return d.first_seen(_links(t), _seed(t))


@query("links_new_per_page", _COUNTED)
def links_new_per_page(t):
    return _counted(t)


@query("links_stop_page", _STOPS)
def links_stop_page(t):
    return d.stop_pages(_counted(t))


@query("links_capped", _CAPPED)
def links_capped(t):
    return d.cap_pages(_counted(t), MAX_NEW)


# The whole rule as one walk over the pages in order, a list of URLs in hand.
def _walk(max_urls: int) -> str:
    return f"""
    WITH RECURSIVE
    found AS (SELECT cat_idx, page_num, list(DISTINCT url) AS urls FROM ({i.LINKS_SQL})
              WHERE url NOT IN ({_SEED}) GROUP BY ALL),
    steps AS (SELECT row_number() OVER (ORDER BY p.cat_idx, p.page_num) AS g, p.cat_idx, p.blocked,
                     coalesce(f.urls, CAST([] AS VARCHAR[])) AS urls
              FROM ({i.PAGES_SQL}) p LEFT JOIN found f USING (cat_idx, page_num)),
    seeded AS (SELECT count(*) AS n FROM ({_SEED})),
    walk AS (
        SELECT 0::BIGINT AS g, 0 AS cat_idx, 0 AS streak, CAST([] AS VARCHAR[]) AS got
        UNION ALL
        SELECT g, cat_idx,
               CASE WHEN NOT visit OR blocked THEN before WHEN len(news) > 0 THEN 0 ELSE before + 1 END,
               CASE WHEN visit AND NOT blocked THEN list_concat(got, news) ELSE got END
        FROM (SELECT s.g, s.cat_idx, s.blocked, w.got,
                     CASE WHEN s.cat_idx = w.cat_idx THEN w.streak ELSE 0 END AS before,
                     (CASE WHEN s.cat_idx = w.cat_idx THEN w.streak ELSE 0 END) < 3
                       AND len(w.got) + (SELECT n FROM seeded) < {max_urls} AS visit,
                     list_filter(s.urls, lambda u: NOT list_contains(w.got, u)) AS news
              FROM walk w JOIN steps s ON s.g = w.g + 1))
    SELECT unnest(got) AS url FROM walk WHERE g = (SELECT max(g) FROM steps)"""


@query("discovery", _walk(1000000000))
def discovery(t):
    return d.discover(_pages(t), _links(t), seed=_seed(t)).select("url")


@query("discovery_capped", _walk(MAX_URLS))
def discovery_capped(t):
    return d.discover(_pages(t), _links(t), seed=_seed(t), max_urls=MAX_URLS).select("url")


@query("discovery_total", f"({_walk(1000000000)}) UNION {_SEED}")
def discovery_total(t):
    """The whole result of a run: what an earlier run had, and what is new."""
    return lifecycle.discover_urls(i.listing_pages(t), i.ORIGIN, seed=_seed(t), pattern="/", blocked=i.LISTING_BLOCKED)


@query("links_by_pattern", f"SELECT p_partkey, '{i.ORIGIN}/x-p-' || p_partkey || '.html' AS url FROM part")
def links_by_pattern(t):
    """Product links among others, told apart by the default pattern."""
    pages = t.part.select("p_partkey", F.format_string(
        '<a href="/about">a</a><a href="/x-p-%d.html?from=list#top">b</a><a name="x-p-1">c</a>', "p_partkey").alias("html"))
    return d.extract_links(pages, i.ORIGIN, keep=("p_partkey",))


_DIM = "(VALUES " + ", ".join(
    f"({n}, '{name}', '{i.ORIGIN}{path}')" for n, name, path in fixed.CATEGORIES) + ") AS c(category_id, name, url)"


@query("category_dim", f"""
    SELECT c.category_id::INTEGER AS category_id, c.name, c.url, count(*) AS events
    FROM events e JOIN {_DIM} ON e.user_id % 26 + 1 = c.category_id GROUP BY ALL""")
def category_dim_query(t):
    per = t.events.groupBy((F.col("user_id") % 26 + 1).cast("int").alias("category_id")).agg(
        F.count("*").alias("events"))
    return per.join(category_dim(t.spark, i.ORIGIN), "category_id").select("category_id", "name", "url", "events")


@query("category_select", f"""
    SELECT s.page_id, s.pos, c.category_id::INTEGER AS category_id, c.url
    FROM (SELECT page_id, unnest([0, 1]) AS pos,
                 unnest([page_id % 30, page_id % 7 + 1]) AS id
          FROM pages WHERE page_id % 11 <> 0) s JOIN {_DIM} ON s.id = c.category_id""")
def category_select(t):
    page = F.col("page_id")
    tail = F.when(page % 11 == 0, ",x").otherwise("")
    choices = t.pages.select("page_id", F.format_string(
        " %d, %d%s", page % 30, page % 7 + 1, tail).alias("choice"))
    chosen = d.select_categories(choices, category_dim(t.spark, i.ORIGIN))
    return chosen.select("page_id", "pos", "category_id", "url")


# -- triage: words that occur in the test pages stand in for the default lists ------
URL_WORDS = ["spam", "Cheap", "ref=x", "feed", "#TOP", "/de/"]
TEXT_WORDS = ["Nicht aulich", "sponsored", "ad 7", "los de la", "tionou", "thou to"]
ALT_WORDS = ["hahe", "auton", "Robot", "the the", "un la"]
MARKERS = ["<ARTICLE", "<nav", "eaea", "class=\"ad\"", "ention", "ouwh", "chle"]
LOGIN = "/es/"


def _any(c, words):
    return "(" + " OR ".join(f"contains(lower({c}), '{w.lower()}')" for w in words) + ")"


def _hits(c, words):
    return "(" + " + ".join(f"contains(lower({c}), '{w.lower()}')::INTEGER" for w in words) + ")"


def _low(t, *extra):
    return t.pages.select("page_id", *extra, F.lower("html").alias("low"))


@query("triage_url", f"SELECT page_id, {_any('url', URL_WORDS)} AS blocked FROM pages")
def triage_url(t):
    return t.pages.select("page_id", triage.url_blocked(F.col("url"), URL_WORDS).alias("blocked"))


@query("triage_text", f"SELECT page_id, {_any('html', TEXT_WORDS)} AS blocked FROM pages")
def triage_text(t):
    return _low(t).select("page_id", triage.text_blocked(F.col("low"), TEXT_WORDS).alias("blocked"))


@query("triage_text_alt", f"SELECT doc_id, {_any('text', ALT_WORDS)} AS blocked FROM documents")
def triage_text_alt(t):
    low = t.spread("documents", "doc_id", "text").select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", triage.text_blocked(F.col("low"), ALT_WORDS).alias("blocked"))


@query("triage_product", f"SELECT page_id, {_hits('html', MARKERS)} >= 4 AS product FROM pages")
def triage_product(t):
    return _low(t).select("page_id", triage.looks_like_product(F.col("low"), MARKERS, 4).alias("product"))


@query("triage_kind", f"""
    SELECT page_id, CASE WHEN {_any('url', URL_WORDS[:3])} THEN 'blocked'
        WHEN contains(lower(url), '{LOGIN}') THEN 'login' WHEN {_any('html', TEXT_WORDS[:3])} THEN 'blocked'
        WHEN {_hits('html', MARKERS)} >= 4 THEN 'product' ELSE 'other' END AS page_kind FROM pages""")
def triage_kind(t):
    kind = triage.page_kind(F.col("url"), F.col("low"), url_patterns=URL_WORDS[:3],
                            text_words=TEXT_WORDS[:3], markers=MARKERS, minimum=4, login_path=LOGIN)
    return _low(t, "url").select("page_id", kind.alias("page_kind"))


@query("triage_listing", f"SELECT page_id, {_any('url', i.LISTING_BLOCKED)} AS blocked FROM pages")
def triage_listing(t):
    pages = d.mark_blocked(t.pages.select("page_id", F.col("url").alias("page_url")), i.LISTING_BLOCKED)
    return pages.select("page_id", "blocked")


@query("triage_marker_counts", "SELECT marker, pages FROM (" + " UNION ALL ".join(
    f"SELECT '{w}' AS marker, count(*) FILTER (contains(lower(html), '{w.lower()}')) AS pages FROM pages"
    for w in MARKERS + TEXT_WORDS) + ") WHERE pages > 0")
def triage_marker_counts(t):
    found = _low(t).select(F.explode(words_found(F.col("low"), MARKERS + TEXT_WORDS)).alias("marker"))
    return found.groupBy("marker").agg(F.count("*").alias("pages"))
