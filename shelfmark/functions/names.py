"""Product names: readable, bounded, safe in file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark import fixed_values as fixed
from shelfmark.functions.text import squeeze, strip, title_case

# After the first squeeze the only whitespace left is the plain space.
_DASH = " ?- ?"
_DASHES = " ?-(?: ?-)+ ?"
_RESERVED = '<>:"|?*'


def _one_space(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def _truncate(c: Column, length: int) -> Column:
    """At most ``length`` characters, cut back to a word boundary if it has one.

    Each step uses its input once, so the plan stays a straight line: keep the
    head when a space follows it; else drop the broken last word; else cut hard.
    Texts that are short enough skip the steps.
    """
    def cut(t: Column) -> Column:
        at_space = F.regexp_replace(t, f"(?s)^(.{{{length}}}) .*$", "$1")
        at_word = F.regexp_replace(
            at_space, rf"(?s)^(.{{1,{length - 1}}}) [^ ]*[^ \-/][ \-/]*(?<=^.{{{length}}}).+$", "$1")
        return F.regexp_replace(at_word, f"(?s)^(.{{{length}}}).+$", "$1")
    short = F.transform(F.array(c), lambda t: F.when(F.length(t) > length, cut(t)).otherwise(t))[0]
    return F.rtrim(short, F.lit(" -/"))


def normalize_name(c: Column, replace_with: str = "", title: bool = True,
                   length: int | None = fixed.NAME_LENGTH) -> Column:
    """A clean name, cut at ``length`` at a word border; None keeps it whole."""
    return cut_name(clean_name(c, replace_with, title), length)


def clean_name(c: Column, replace_with: str = "", title: bool = True) -> Column:
    """A readable name that ``cut_name`` has still to finish, the same for every length."""
    name = F.coalesce(c.cast("string"), F.lit(""))
    name = squeeze(F.regexp_replace(name, r"[\\/]+", " - "))
    name = F.regexp_replace(name, _DASHES, " - ")
    name = _one_space(F.translate(name, ",", ""))
    name = F.trim(F.regexp_replace(name, _DASH, " - "))
    if title:
        name = title_case(name)
    if len(replace_with) < 2 and not replace_with.isspace():
        name = F.translate(name, _RESERVED, replace_with * len(_RESERVED))
    else:
        name = squeeze(F.regexp_replace(name, f"[{_RESERVED}]", replace_with.replace("\\", "\\\\")))
    name = F.regexp_replace(_one_space(name), _DASH, " - ")
    return F.rtrim(F.trim(name), F.lit("-/"))


def cut_name(name: Column, length: int | None = fixed.NAME_LENGTH) -> Column:
    if length is not None:
        name = _truncate(name, length)
    name = F.regexp_replace(_one_space(name), _DASHES, " - ")
    return F.rtrim(F.trim(name), F.lit("-/"))


def safe_name(c: Column, length: int | None = fixed.NAME_LENGTH) -> Column:
    """Without characters that file systems reserve; at most ``length`` characters, None for all."""
    clean = F.regexp_replace(c, r'[<>:"/\\|?*]', "")
    return strip(clean if length is None else F.left(clean, F.lit(length)))
