"""JSON replies wrapped in prose or code fences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.functions.text import strip


def without_fences(reply: Column) -> Column:
    bare = F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return strip(bare)


# How any JSON text starts; a cheap test that spares most failing parses.
_STARTS = r"^(?:[\[{\"]|-?[0-9]|true$|false$|null$)"


def salvage_json(reply: Column) -> Column:
    """The reply as VARIANT; failing that its first flat ``{...}``; else NULL."""
    text = without_fences(reply)
    flat = F.regexp_extract(text, r"\{[^{}]*\}", 0)
    return F.coalesce(F.when(F.rlike(text, F.lit(_STARTS)), F.try_parse_json(text)),
                      F.when(flat != "", F.try_parse_json(flat)))
