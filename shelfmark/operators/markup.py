"""One parse per page: HTML in, raw candidate columns out.

This is the only per-row Python of the batch jobs. It runs inside
``mapInArrow`` tasks, one page at a time, and hands over raw text; casing,
money, fallbacks and every other rule are column expressions downstream.
A page is kept as a preorder table of nodes in which the subtree of node ``i``
is the row range ``i + 1 .. end[i]``.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark import fixed_values as fixed
from shelfmark.operators.blocks import CONTRACT_LIMITS, SpecLimits

_S = T.StringType()
_STRINGS = T.ArrayType(_S)
_NODE = T.StructType([T.StructField("kind", _S), T.StructField("label", _S), T.StructField("text", _S)])
_OPTION = T.StructType([T.StructField("aria", _S), T.StructField("classes", _STRINGS)])
_SIZE = T.StructType([T.StructField("aria", _S), T.StructField("text", _S),
                      T.StructField("classes", _STRINGS)])

# Candidate columns by the part of the product record that needs them.
FIELDS: dict[str, list[T.StructField]] = {
    "name": [T.StructField("name_c", _STRINGS)],
    "price": [T.StructField("cur_json", _STRINGS), T.StructField("cur_c", _STRINGS),
              T.StructField("old_json", _STRINGS), T.StructField("old_c", _STRINGS),
              T.StructField("disc_c", _STRINGS)],
    "description": [T.StructField("desc_c", _S), T.StructField("block", T.ArrayType(_NODE)),
                    T.StructField("spec_texts", T.ArrayType(_STRINGS)), T.StructField("goods_desc", _STRINGS)],
    "shipping": [T.StructField("ship", T.ArrayType(T.ArrayType(_OPTION)))],
    "sizes": [T.StructField("sizes_el", T.ArrayType(_SIZE))],
    "sku": [T.StructField("sku_c", _S)],
    "reviews": [T.StructField("review_c", _S), T.StructField("review_sib", _S)],
    "links": [T.StructField("links", _STRINGS)],
}
PRODUCT_FIELDS = ("name", "price", "description", "shipping", "sizes", "sku", "reviews")


@dataclass(frozen=True)
class ExtractConfig:
    """What to look for; every list can be replaced to suit another site."""
    name: list = field(default_factory=lambda: fixed.NAME_SELECTORS)
    price: list = field(default_factory=lambda: fixed.PRICE_SELECTORS)
    old_price: list = field(default_factory=lambda: fixed.OLD_PRICE_SELECTORS)
    discount: list = field(default_factory=lambda: fixed.DISCOUNT_SELECTORS)
    description: list = field(default_factory=lambda: fixed.DESCRIPTION_SELECTORS)
    shipping: list = field(default_factory=lambda: fixed.SHIPPING_SELECTORS)
    size_class: str = fixed.SIZE_CLASS
    link_pattern: str = fixed.PRODUCT_LINK
    spec: SpecLimits = CONTRACT_LIMITS


# Elements without content, and elements whose strings are not page text.
_VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source "
                  "track wbr basefont bgsound command frame image isindex nextid spacer".split())
_SILENT = frozenset(["script", "style", "template", "rt", "rp"])

# Tags that every version of the library reads alike: an end tag, or a start tag whose values are quoted and free of references.
_TAG = re.compile(r'<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?: +[a-zA-Z][a-zA-Z0-9:._-]*(?:="[^"&]*")?)*) *)>')
_ATTR = re.compile(r' ([a-zA-Z][a-zA-Z0-9:._-]*)(?:="([^"]*)")?')
# Elements whose text some version of the library reads in another way, and the end of those that all take as raw.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
_RAW_END = {tag: re.compile(rf"</\s*{tag}", re.IGNORECASE) for tag in ("script", "style")}
# Attribute texts up to this length, and tests of them, are remembered, so many at a time; they come again and again.
# Plain dicts, as the functions here travel inside the task; what they hold is never changed.
_SHORT, _MOST = 256, 1 << 14
_ATTRS: dict[str, dict[str, str]] = {}
_SEEN: dict[tuple[str, str, str, bool], bool] = {}


def _attributes(source: str) -> dict[str, str]:
    found = {k.lower(): v for k, v in _ATTR.findall(source)}
    if len(source) <= _SHORT:
        if len(_ATTRS) >= _MOST:
            _ATTRS.clear()
        _ATTRS[source] = found
    return found


def _fits(test: str, value: str, text: str, is_class: bool) -> bool:
    tokens = text.split() if is_class else [text]
    if test == "like":
        fits = re.search(value, " ".join(tokens), re.IGNORECASE) is not None
    else:
        fits = value in tokens or " ".join(tokens) == value
    if len(text) <= _SHORT:
        if len(_SEEN) >= _MOST:
            _SEEN.clear()
        _SEEN[test, value, text, is_class] = fits
    return fits


class PageNodes(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag: list[str | None] = ["[page]"]
        self.attr: list = [{}]
        self.up: list[int] = [-1]
        self.end: list[int] = [0]
        self.open: list[int] = [0]
        self.opened: dict[str, int] = {}
        self.silent = 0
        self.at: list[int] = []             # node numbers of the strings, ascending
        self.raw: list[str] = []            # their text
        self.shown: list[bool] = []         # part of the page text?
        self.joinable = False
        self.by_tag: dict[str, list[int]] = {}
        self.tokens: dict[int, list[str]] = {}
        self.feed(html)
        self.close()
        while self.open:
            self._shut()
        self.trimmed = [s.strip() if ok else "" for s, ok in zip(self.raw, self.shown)]

    # -- building ---------------------------------------------------------
    def goahead(self, end):
        """The library's loop with a short way for plain tags and the text before them, which it adds as
        ``enter``, ``handle_data`` and ``handle_endtag`` do; whatever else a page holds goes to the library's own methods."""
        source = self.rawdata
        i, n = 0, len(source)
        find, match, tags, attr, up, ends, stack = source.find, _TAG.match, self.tag, self.attr, self.up, self.end, self.open
        at, raw, shown, by_tag, opened = self.at, self.raw, self.shown, self.by_tag, self.opened
        while i < n:
            plain = None
            if self.cdata_elem is None:
                j = find("<", i)
                if j < 0:
                    break
                plain = match(source, j)
            else:
                stop = _RAW_END.get(self.cdata_elem)
                closing = stop and stop.search(source, i)
                if not closing or closing[0].lower() != f"</{self.cdata_elem}" or not source.startswith(">", closing.end()):
                    break
                j = closing.start()
            if i < j:
                text = source[i:j]
                if "&" in text and self.cdata_elem is None:
                    text = unescape(text)
                if self.joinable:
                    raw[-1] += text
                else:
                    row = len(tags)
                    tags.append(None)
                    attr.append(None)
                    up.append(stack[-1])
                    ends.append(row + 1)
                    at.append(row)
                    raw.append(text)
                    shown.append(not self.silent)
                    self.joinable = True
                i = j
            if plain is not None:
                closed, tag, given = plain.groups()
                if closed is not None:
                    self.joinable = False
                    tag = closed.lower()
                    if opened.get(tag, 0) > 0:
                        while self._shut() != tag:
                            pass
                    i = plain.end()
                    continue
                tag = tag.lower()
                if tag not in _RAW:
                    known = _ATTRS.get(given)
                    self.enter(tag, _attributes(given) if known is None else known)
                    i = plain.end()
                    continue
            mark = source[i + 1:i + 2]
            if mark.isascii() and mark.isalpha():
                k = self.parse_starttag(i)
            elif mark == "/":
                k = self.parse_endtag(i)
            elif source.startswith("<!--", i):
                k = self.parse_comment(i)
            elif mark == "!":
                k = self.parse_html_declaration(i)
            else:
                break
            if k < 0:
                break
            i = k
        self.rawdata = source[i:]
        super().goahead(end)

    def updatepos(self, i, j):
        return j        # line numbers are of no use here

    def _shut(self) -> str | None:
        n = self.open.pop()
        tag = self.tag[n]
        self.end[n] = len(self.tag)
        self.opened[tag] = self.opened.get(tag, 0) - 1
        self.silent -= tag in _SILENT
        return tag

    def _string(self, text: str, shown: bool) -> None:
        n = len(self.tag)
        self.tag.append(None)
        self.attr.append(None)
        self.up.append(self.open[-1])
        self.end.append(n + 1)
        self.at.append(n)
        self.raw.append(text)
        self.shown.append(shown)

    def handle_starttag(self, tag, attrs):
        self.enter(tag, {k: v or "" for k, v in attrs})

    def enter(self, tag: str, attr: dict[str, str]) -> None:
        self.joinable = False
        n = len(self.tag)
        self.tag.append(tag)
        self.attr.append(attr)
        self.up.append(self.open[-1])
        self.end.append(n + 1)
        rows = self.by_tag.get(tag)
        if rows is None:
            self.by_tag[tag] = [n]
        else:
            rows.append(n)
        if tag not in _VOID:
            self.open.append(n)
            self.opened[tag] = self.opened.get(tag, 0) + 1
            self.silent += tag in _SILENT

    def handle_endtag(self, tag):
        self.joinable = False
        if self.opened.get(tag, 0) > 0:
            while self._shut() != tag:
                pass

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.joinable:
            self.raw[-1] += data
        else:
            self._string(data, not self.silent)
            self.joinable = True

    def handle_comment(self, data):
        self.joinable = False
        self._string(data, False)

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.joinable = False
        cdata = data[:6].upper() == "CDATA["
        self._string(data[6:] if cdata else data, cdata and not self.silent)

    # -- asking -----------------------------------------------------------
    def within(self, n: int, *tags: str) -> list[int]:
        """Descendants of ``n`` with one of the tags, in document order."""
        found = []
        for tag in tags:
            rows = self.by_tag.get(tag, [])
            found += rows[bisect_left(rows, n + 1):bisect_left(rows, self.end[n])]
        return sorted(found) if len(tags) > 1 else found

    def text(self, n: int, glue: str = " ") -> str:
        span = slice(bisect_left(self.at, n), bisect_left(self.at, self.end[n]))
        return glue.join(filter(None, self.trimmed[span]))

    def classes(self, n: int) -> list[str]:
        tokens = self.tokens.get(n)
        if tokens is None:
            tokens = self.tokens[n] = self.attr[n].get("class", "").split()
        return tokens

    def select(self, selector) -> Iterator[int]:
        tag, name, test, value = selector
        rows = self.by_tag.get(tag, [])
        if name is None:
            yield from rows
            return
        attr, is_class = self.attr, name == "class"
        for n in rows:
            text = attr[n].get(name)
            if text is not None:
                fits = _SEEN.get((test, value, text, is_class))
                if _fits(test, value, text, is_class) if fits is None else fits:
                    yield n

    def first_texts(self, selectors, glue: str) -> list[str | None]:
        """One slot per selector: the text of its first match, or None."""
        hits = (next(self.select(s), None) if s[0] in self.by_tag else None for s in selectors)
        return [None if n is None else self.text(n, glue) for n in hits]

    def scripts(self, kind: str | None = None) -> Iterator[tuple[int, str]]:
        for n in self.by_tag.get("script", []):
            if kind is None or self.attr[n].get("type") == kind:
                i = bisect_left(self.at, n)
                if i < len(self.at) and self.at[i] < self.end[n] and self.raw[i]:
                    yield n, self.raw[i]


class LinkScan(HTMLParser):
    """Only the ``href`` of every ``<a>``; no nodes are kept."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []
        self.feed(html)
        self.close()

    def updatepos(self, i, j):
        return j

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            found = [v or "" for k, v in attrs if k == "href"]
            self.hrefs += found[-1:]


# -- embedded JSON ------------------------------------------------------------
def _load(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _walk(data) -> Iterator[dict]:
    """Objects in source order, parents first; ``.send(True)`` skips the children."""
    todo = [data]
    while todo:
        item = todo.pop()
        skip = False
        if isinstance(item, dict):
            skip = yield item
            if skip:
                yield {}
        if not skip:
            inner = item.values() if isinstance(item, dict) else item if isinstance(item, list) else ()
            todo += reversed(list(inner))


def _current_amount(data) -> str | None:
    if not isinstance(data, dict):
        return None
    promo = data.get("promotionInfoPrice")
    if not promo and isinstance(data.get("detail"), dict):
        promo = data["detail"].get("promotionInfoPrice")
    amount = promo.get("amountWithSymbol") if isinstance(promo, dict) else None
    return amount if isinstance(amount, str) and amount else None


def _original_amount(data) -> str | None:
    for item in _walk(data):
        price = item.get("originalPrice")
        amount = price.get("amountWithSymbol") if isinstance(price, dict) else None
        if isinstance(amount, str) and amount:
            return amount
    return None


def _goods_text(data) -> str | None:
    objects = _walk(data)
    for item in objects:
        text = item.get("goods_desc")
        if isinstance(text, str):
            if text:
                return text
            objects.send(True)
    return None


# -- description block ---------------------------------------------------------
def _attribute_block(page: PageNodes) -> int | None:
    named = [n for n, a in enumerate(page.attr)
             if a and a.get("name") == fixed.ATTRIBUTE_BLOCK_NAME]
    exact = (n for n in named if page.tag[n] == "div"
             and (fixed.ATTRIBUTE_BLOCK_CLASS in page.classes(n)))
    return next(exact, named[0] if named else None)


def _block_nodes(page: PageNodes, block: int) -> Iterator[tuple[str, str, str]]:
    """(kind, label, text) of what may be an attribute: ready pairs, rows, then all free text."""
    for dl in page.within(block, "dl"):
        for names in zip(page.within(dl, "dt"), page.within(dl, "dd")):
            yield "pair", *map(page.text, names)
    rows = {n for table in page.within(block, "table") for n in page.within(table, "tr")}
    for cells in (page.within(tr, "td", "th") for tr in sorted(rows)):
        if len(cells) > 1:
            yield "pair", page.text(cells[0]), page.text(cells[1])
    bold: dict[int, int] = {}  # the first marked child of a row
    for n in page.within(block, "b", "strong", "label"):
        bold.setdefault(page.up[n], n)
    for row in page.within(block, "div", "li", "p", "span"):
        yield "row", page.text(bold[row]) if row in bold else "", page.text(row)
    for n in page.within(block, "p", "span", "li"):
        yield "text", "", page.text(n)


def _spec_texts(scripts: Iterable[str], limits: SpecLimits) -> list[list[str]]:
    """The text nodes around the mark of each script that has it."""
    out: list[list[str]] = []
    for text in scripts:
        at = text.find(limits.mark)
        if at < 0 or limits.scripts is not None and len(out) >= limits.scripts:
            continue
        stop = len(text) if limits.window is None else at + limits.window
        again = text.find(limits.mark, at + 1) if limits.until_next_mark else -1
        nodes = PageNodes(text[max(0, at - limits.before):again if again >= 0 else stop])
        out.append([s for s in map(str.strip, nodes.raw) if s])
    return out


# -- the candidate row ---------------------------------------------------------
def _sku_parent(page: PageNodes) -> int | None:
    for n, text in zip(page.at, page.raw):
        if "SKU" in text and page.tag[page.up[n]] not in ("script", "style"):
            return page.up[n]
    return None


def _sibling_review(page: PageNodes, sku: int | None) -> str | None:
    row = page.up[sku] if sku else 0
    if row <= 0:
        return None
    n, parent_end = page.end[row], page.end[page.up[row]]
    while n < parent_end:
        if page.tag[n] is not None:
            text = page.text(n)
            if "Review" in text or "(" in text:
                return text
        n = page.end[n]
    return None


def candidates(html: str, fields: tuple[str, ...], config: ExtractConfig) -> dict:
    row: dict = {}
    if "links" in fields:
        row["links"] = [h for h in LinkScan(html or "").hrefs if config.link_pattern in h]
        if fields == ("links",):
            return row
    page = PageNodes(html or "")
    if "name" in fields:
        row["name_c"] = page.first_texts(config.name, " ")
    if "price" in fields:
        loaded = [(s, _load(s)) for _, s in page.scripts("application/json")
                  if "amountWithSymbol" in s or "\\u" in s]
        row["cur_json"] = [a for _, d in loaded if (a := _current_amount(d))]
        row["old_json"] = [a for s, d in loaded
                           if "originalPrice" in s and (a := _original_amount(d))]
        row["cur_c"] = page.first_texts(config.price, "")
        row["old_c"] = page.first_texts(config.old_price, "")
        row["disc_c"] = page.first_texts(config.discount, "")
    if "description" in fields:
        block = _attribute_block(page)
        outside = [s for n, s in page.scripts()
                   if block is None or not block < n < page.end[block]]
        first = next((n for s in config.description for n in page.select(s)), None)
        row["desc_c"] = None if first is None else page.text(first, "")
        row["block"] = [] if block is None else [
            {"kind": kind, "label": label, "text": text} for kind, label, text in _block_nodes(page, block) if text]
        row["spec_texts"] = _spec_texts(outside, config.spec)
        row["goods_desc"] = [t for s in outside if '"goods_desc"' in s or "'goods_desc'" in s
                             if (t := _goods_text(_load(s)))]
    if "shipping" in fields:
        row["ship"] = [[{"aria": page.attr[n]["aria-label"], "classes": page.classes(n)}
                        for n in page.select(s) if "aria-label" in page.attr[n]]
                       for s in config.shipping]
    if "sizes" in fields:
        row["sizes_el"] = [{"aria": page.attr[n].get("aria-label"), "text": page.text(n, ""),
                            "classes": page.classes(n)}
                           for n in page.by_tag.get("div", [])
                           if config.size_class in page.attr[n].get("class", "")]
    if "sku" in fields or "reviews" in fields:
        sku = _sku_parent(page)
    if "sku" in fields:
        row["sku_c"] = None if sku is None else page.text(sku, "")
    if "reviews" in fields:
        rated = next(page.select(("div", "class", "like", "reviews|rate")), None)
        row["review_c"] = None if rated is None else page.text(rated)
        row["review_sib"] = _sibling_review(page, sku)
    return row


def parse_pages(df: DataFrame, fields: tuple[str, ...] = PRODUCT_FIELDS, *,
                keep: tuple[str, ...] = ("url",), html: str = "html",
                config: ExtractConfig | None = None) -> DataFrame:
    """``keep`` columns plus the candidate columns of ``fields`` and ``_error``.

    The page text itself is dropped here, so downstream shuffles carry only the
    narrow candidates. Filter and anti-join before this step, not after it.
    """
    config = config or ExtractConfig()
    kept = df.select(*keep, html)
    extra = [column for name in fields for column in FIELDS[name]]
    schema = T.StructType([kept.schema[k] for k in keep] + extra + [T.StructField("_error", _S)])
    arrow_types = to_arrow_schema(T.StructType(extra))
    names = [c.name for c in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for text in batch.column(len(keep)).to_pylist():
                try:
                    rows.append(candidates(text, fields, config))
                    errors.append(None)
                except Exception as broken:  # one bad page must not end the job
                    rows.append({})
                    errors.append(f"{type(broken).__name__}: {broken}")
            columns = [pa.array([r.get(n) for r in rows], type=arrow_types.field(n).type)
                       for n in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + columns
                + [pa.array(errors, type=pa.string())],
                names=[*keep, *names, "_error"])

    return kept.mapInArrow(run, schema)
