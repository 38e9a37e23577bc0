"""Text columns with Unicode-aware trimming and casing.

Spark's ``trim`` only knows the space and Java's ``\\s`` only ASCII, so the
whitespace set is spelled out once and used everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every code point that counts as whitespace in text processing.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
          "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NON_WS = WS.replace("[", "[^", 1)

# Characters that have case; the letter after one of these is lower-cased.
_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"

# The mark that opens a word, and characters that may need care: ``initcap`` cases all letters of these Latin and
# Cyrillic ranges one by one, as ``upper_first`` does; a text with any other cased letter (final sigma, digraphs)
# or with the mark is taken run by run.
_MARK = "\ue000"
_ODD = (rf"[^\x00-\u012f](?<=[{_CASED}{_MARK}&&[^\u0131-\u0148\u014a-\u01c3\u01cd-\u01f0\u01f4-\u024f"
        r"\u0400-\u052f\u1e00-\u1e95\u1ea0-\u1eff]])")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def left_strip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Whitespace runs become one space."""
    return F.regexp_replace(c, WS + "+", " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_token(c: Column) -> Column:
    return F.regexp_extract(c, f"^{WS}*({NON_WS}*)", 1)


def upper_first(c: Column) -> Column:
    """First letter in title case, the rest in lower case.

    A letter whose upper form has several characters (ß -> SS) keeps only the
    first of them in upper case.
    """
    head = F.upper(F.left(c, F.lit(1)))
    tail = F.substr(F.lower(c), F.length(F.lower(F.left(c, F.lit(1)))) + 1)
    return F.concat(F.left(head, F.lit(1)), F.lower(F.substr(head, F.lit(2))), tail)


def title_case(c: Column) -> Column:
    """Every run of cased letters starts in upper case: ``5pcs`` -> ``5Pcs``."""
    def cased(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
        # A space before every run makes it a word.
        words = F.initcap(F.regexp_replace(t, f"[^A-Za-z {_CASED}](?=[{_CASED}])", f"$0{_MARK} "))
        odd = (F.octet_length(t) > F.length(t)) & F.rlike(t, F.lit(_ODD))
        return (F.when(odd, F.array_join(F.transform(pieces, upper_first), ""))
                .otherwise(F.replace(words, F.lit(f"{_MARK} "), F.lit(""))))
    return F.transform(F.array(c), cased)[0]


def contains_any(c: Column, words: list[str]) -> Column:
    """True when a word occurs; ``c`` and the words are compared as given."""
    if not words:
        return F.lit(False)
    hit = F.contains(c, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(c, F.lit(word))
    return hit


def words_found(c: Column, words: list[str]) -> Column:
    """The words that occur, in list order; matching is on lower-case text."""
    slots = [F.when(F.contains(c, F.lit(w.lower())), F.lit(w)) for w in words]
    return F.array_compact(F.array(*slots))


def count_found(c: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + F.contains(c, F.lit(word.lower())).cast("int")
    return total
