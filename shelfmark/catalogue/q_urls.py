"""URL lists: sources, sinks, projections, cleaners."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.catalogue import inputs as i
from shelfmark.catalogue.registry import query
from shelfmark.functions import urls
from shelfmark.operators import urllists
from shelfmark.session import work_path
from shelfmark.sources import urllists as files
from shelfmark.sources.pages import read_pages

_TOKEN = "regexp_extract(line, '^(\\S*)', 1)"


@query("url_list_read", f"SELECT line FROM ({i.TRIMMED_SQL})")
def url_list_read(t):
    path = work_path(t.spark, "url-list")
    i.url_lines(t).select("line").write.text(path)
    return files.read_lines(t.spark, path).select("line")


@query("discovery_seed", f"SELECT DISTINCT {i.canonical_sql('line')} AS url FROM ({i.KEPT_SQL})")
def discovery_seed(t):
    return files.seed_urls(i.url_lines(t))


@query("seed_from_list", f"""
    SELECT DISTINCT url FROM (
        SELECT {i.canonical_sql('url')} AS url FROM (SELECT trim(url) AS url FROM pages WHERE page_id % 3 = 0)
        UNION ALL SELECT {i.canonical_sql('url')} FROM (SELECT trim(url) AS url FROM pages WHERE page_id % 5 = 0))""")
def seed_from_list(t):
    """A list with header and comments that two runs have appended to, read back as seed."""
    path = work_path(t.spark, "found-list")
    files.write_clean_list(t.pages.where("page_id % 3 = 0").select("url"), path)
    files.append_found(t.pages.where("page_id % 5 = 0").select("url"), path)
    t.pages.limit(1).select(F.lit("  # a comment of a user").alias("value")).write.mode("append").text(path)
    return files.read_seed(t.spark, path)


@query("url_list_write", f"""
    SELECT line AS value, 2::BIGINT AS copies
    FROM (SELECT DISTINCT regexp_replace(line, '\\s+', ' ') AS line FROM ({i.PREPROCESSED_SQL}))""")
def url_list_write(t):
    path = work_path(t.spark, "url-list-out")
    lines = urllists.split_lines(urllists.clean_ordered(i.url_lines(t)))
    files.write_list(lines, path, local_path="local_path")
    both = t.spark.read.text([path, f"{path}-backup"])
    return both.groupBy("value").agg(F.count("*").alias("copies"))


@query("url_list_header", f"""
    SELECT DISTINCT {i.canonical_sql('line')} AS value FROM ({i.KEPT_SQL})
    UNION ALL SELECT '# One product URL per line. Lines starting with # are ignored.'""")
def url_list_header(t):
    path = work_path(t.spark, "url-list-clean")
    files.write_clean_list(urllists.clean_distinct(i.url_lines(t)), path)
    return t.spark.read.text(path)


@query("url_trim", i.TRIMMED_SQL)
def url_trim(t):
    return urllists.trim_lines(i.url_lines(t))


@query("url_comments", i.KEPT_SQL)
def url_comments(t):
    return urllists.drop_comments(urllists.trim_lines(i.url_lines(t)))


@query("url_dash", f"SELECT pos, regexp_replace(line, '^\\s*--?\\s+', '') AS line FROM ({i.LINES_SQL})")
def url_dash(t):
    return urllists.drop_dashes(i.url_lines(t))


@query("url_canon", f"SELECT page_id, {i.canonical_sql('url')} AS url FROM pages")
def url_canon(t):
    return t.pages.select("page_id", urls.canonical(F.col("url")).alias("url"))


_LINK = "regexp_extract(url, '^https?:(//[^/]+)?(/.*)$', "


@query("url_absolute", f"""
    SELECT page_id, CASE WHEN starts_with(h, '/') THEN '{i.ORIGIN}' || h ELSE h END AS url,
           CASE WHEN starts_with(h, '//') THEN 'https:' || h
                WHEN starts_with(h, '/') THEN '{i.ORIGIN}' || h ELSE h END AS resolved
    FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN {_LINK} 2)
                 WHEN 1 THEN {_LINK} 1) || {_LINK} 2) ELSE url END AS h FROM pages)""")
def url_absolute(t):
    def part(n):
        return F.regexp_extract("url", "^https?:(//[^/]+)?(/.*)$", n)
    href = (F.when(F.col("page_id") % 3 == 0, part(2))
            .when(F.col("page_id") % 3 == 1, F.concat(part(1), part(2))).otherwise(F.col("url")))
    return t.pages.select("page_id", href.alias("h")).select(
        "page_id", urls.absolute(F.col("h"), i.ORIGIN).alias("url"),
        urls.absolute(F.col("h"), i.ORIGIN, resolve=True).alias("resolved"))


@query("url_split", f"""
    SELECT pos, {_TOKEN} AS url, nullif(regexp_extract(line, '^\\S+\\s+(.*)$', 1), '') AS local_path
    FROM ({i.PREPROCESSED_SQL})""")
def url_split(t):
    return urllists.split_lines(urllists.preprocess(i.url_lines(t))).drop("line")


@query("url_sort", f"SELECT pos, line FROM ({i.TRIMMED_SQL}) ORDER BY lower({_TOKEN}), line")
def url_sort(t):
    return urllists.sort_lines(urllists.trim_lines(i.url_lines(t)))


@query("url_preprocess", i.PREPROCESSED_SQL)
def url_preprocess(t):
    return urllists.sort_lines(urllists.preprocess(i.url_lines(t)))


@query("url_clean_distinct", f"SELECT DISTINCT {i.canonical_sql('line')} AS url FROM ({i.KEPT_SQL})")
def url_clean_distinct(t):
    return urllists.clean_distinct(i.url_lines(t)).orderBy(F.lower("url"), "url")


@query("url_clean_ordered", f"""
    SELECT line, min(pos) AS pos FROM ({i.PREPROCESSED_SQL}) GROUP BY line""")
def url_clean_ordered(t):
    return urllists.sort_lines(urllists.clean_ordered(i.url_lines(t)))


@query("url_clean_recommended", f"""
    SELECT DISTINCT {i.canonical_sql('line')} AS url
    FROM (SELECT {_TOKEN} AS line FROM ({i.PREPROCESSED_SQL}))""")
def url_clean_recommended(t):
    return urllists.clean_recommended(i.url_lines(t))


@query("page_urls", """
    SELECT page_id, n::INTEGER AS page_num,
           url || (CASE WHEN contains(url, '?') THEN '&' ELSE '?' END) || 'page=' || n AS page_url
    FROM (SELECT page_id, url, unnest(generate_series(1, page_id % 5 + 1)) AS n FROM pages)""")
def page_urls(t):
    cats = t.pages.select("page_id", "url", (F.col("page_id") % 5 + 1).alias("last"))
    return urllists.page_urls(cats, "last").select("page_id", "page_num", "page_url")


@query("url_shortlink", """
    SELECT page_id, regexp_matches(url, 'https?://spam-farm\\.example\\.org/[A-Za-z0-9/]+') AS short
    FROM pages""")
def url_shortlink(t):
    return t.pages.select("page_id", urls.is_short_link(F.col("url"), "spam-farm.example.org").alias("short"))


@query("url_html_join", f"""
    SELECT l.pos, l.url, l.local_path, length(p.html) AS html_chars
    FROM (SELECT pos, {_TOKEN} AS url,
                 nullif(regexp_extract(line, '^\\S+\\s+(.*)$', 1), '') AS local_path
          FROM ({i.PREPROCESSED_SQL})) l
    LEFT JOIN pages p ON l.local_path = 'local/' || p.page_id || '.html'""")
def url_html_join(t):
    lines = urllists.split_lines(urllists.preprocess(i.url_lines(t)))
    pages = t.pages.select(F.format_string("local/%d.html", "page_id").alias("path"), "html")
    return urllists.with_local_html(lines, pages, {"html_chars": F.length("html").cast("bigint")}).select(
        "pos", "url", "local_path", "html_chars")


@query("pages_scan", "SELECT page_id, url, length(html) AS html_chars FROM pages")
def pages_scan(t):
    pages = read_pages(t.spark, f"{t.folder}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("html_chars"))
