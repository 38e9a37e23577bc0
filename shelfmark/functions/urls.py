"""URL columns: clean, canonicalise, split and generate."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark import fixed_values as fixed
from shelfmark.functions.text import WS, first_token, left_strip, strip


def is_comment(c: Column) -> Column:
    return F.startswith(left_strip(c), F.lit("#"))


def drop_dash(c: Column) -> Column:
    """Remove one leading ``- `` or ``-- `` list marker."""
    return F.regexp_replace(c, f"^{WS}*--?{WS}+", "")


def canonical(c: Column) -> Column:
    """Cut after the first ``.html``; other URLs keep query and fragment."""
    return F.when(F.contains(c, F.lit(".html")),
                  F.concat(F.substring_index(c, ".html", 1), F.lit(".html"))).otherwise(c)


def absolute(c: Column, origin: str, resolve: bool = False) -> Column:
    """Prefix site-relative links with the origin.

    ``//host/x`` also gets the origin in front, as in the original list files;
    ``resolve=True`` gives such links the scheme of the origin instead.
    """
    joined = F.when(F.startswith(c, F.lit("/")), F.concat(F.lit(origin), c)).otherwise(c)
    if not resolve:
        return joined
    scheme = origin.split("//", 1)[0]
    return F.when(F.startswith(c, F.lit("//")), F.concat(F.lit(scheme), c)).otherwise(joined)


def list_url(line: Column) -> Column:
    return first_token(strip(line))


def list_path(line: Column) -> Column:
    """The local file named after the URL, NULL when there is none."""
    return F.get(F.split(strip(line), WS + "+", 2), F.lit(1))


def sort_key(line: Column) -> Column:
    return F.lower(first_token(line))


def page_url(category_url: Column, page: Column) -> Column:
    mark = F.when(F.contains(category_url, F.lit("?")), F.lit("&page=")).otherwise(F.lit("?page="))
    return F.concat(category_url, mark, page.cast("string"))


def is_product_link(href: Column, pattern: str = fixed.PRODUCT_LINK) -> Column:
    return F.contains(href, F.lit(pattern))


def is_short_link(c: Column, host: str) -> Column:
    """A link-shortener address on ``host`` followed by letters, digits, ``/``."""
    return F.rlike(c, F.lit(f"https?://{host.replace('.', chr(92) + '.')}/[A-Za-z0-9/]+"))
