"""Leaf blocks of a web page: runs of text between block-level tags, with what stands around them.

The work grows with the length of the page, however deep its elements nest.
"""

from __future__ import annotations

import re
from html import unescape

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead tr ul button label".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of a page's prose.
SILENT_TAGS = "script|style|title|textarea|template|iframe|noscript|noframes|svg|math|object|xmp"
#: An opening tag closes open elements of these names, up to the given ancestors.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"})}
_KEEPS_P = {"table", "td", "th", "caption", "button", "html"}

_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<silent>{SILENT_TAGS})\b{_ATTRIBUTES}>.*?(?:</(?P=silent)\s*>|\Z)|<[!?][^>]*>"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>{_ATTRIBUTES}|[^>]*)>", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def names(attributes: str) -> tuple[str, ...]:
    """Words in class, id, role, itemprop and aria-label, lower case, without plural s."""
    found = [a or b or c for a, b, c in _NAMES.findall(attributes)]
    out = {w.lower() for value in found for w in _WORD.findall(value)}
    out = {w[:-1] if len(w) > 2 and w.endswith("s") and not w.endswith("ss") else w for w in out}
    if _HIDDEN.search(attributes):
        out.add("hidden")
    return tuple(sorted(out))


class Node:
    """An open element; its ancestors are found by its parents, so a deep page copies no paths."""

    __slots__ = ("tag", "names", "parent", "heading", "context")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.heading = tag in ("h1", "h2") or parent is not None and parent.heading
        self.context = None  # what a reader of the blocks has worked out for this element


class Block:
    __slots__ = ("text", "node", "linked", "after")

    def __init__(self, text: str, node: Node | None, linked: float, after: int):
        #: node: the innermost open element; after: headings seen before.
        self.text, self.node, self.linked, self.after = text, node, linked, after

    @property
    def path(self) -> list[tuple[str, tuple[str, ...]]]:
        """(tag, names) of every open element, outermost first."""
        out, node = [], self.node
        while node is not None:
            out.append((node.tag, node.names))
            node = node.parent
        return out[::-1]


class _Open:
    """The open elements, and for each tag where it stands among them."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.at.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(Node(tag, names, self.top()))

    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def find(self, tags, barrier=()) -> int | None:
        """The innermost of ``tags`` with no ``barrier`` inside it."""
        at = self.last(tags)
        wall = (self.blocks[-1] if self.blocks else -1) if barrier is BLOCK_TAGS else self.last(barrier)
        return at if at > wall or at >= 0 and at == wall else None


def blocks(html: str | None) -> list[Block]:
    """The non-empty leaf blocks in page order; white space is one blank, references are decoded."""
    out: list[Block] = []
    if not html:
        return out
    stack = _Open()
    links = stack.at.setdefault("a", [])
    held: list[str] = []
    linked, headings, node = 0, 0, None

    def flush() -> None:
        nonlocal held, linked, headings
        if held:
            raw = "".join(held)
            text = " ".join(unescape(raw).split())
            if text:
                out.append(Block(text, node, min(1.0, linked / max(1, len(raw.strip()))), headings))
                headings += node is not None and node.heading
            held, linked = [], 0

    def put(piece: str) -> None:
        nonlocal node, linked
        if not piece:
            return
        if not held:
            node = stack.top()
        held.append(piece)
        if links:
            linked += len(piece.strip())

    last = 0
    for token in _TOKEN.finditer(html):
        put(html[last:token.start()])
        last = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["end"]:
            if tag in BLOCK_TAGS:
                flush()
                at = stack.find({tag})
            else:
                at = stack.find({tag}, BLOCK_TAGS)
            if at is not None:
                if stack.blocks and stack.blocks[-1] >= at:
                    flush()
                stack.cut(at)
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag not in ("option", "optgroup", "label", "button", "select") and (at := stack.find({"p"}, _KEEPS_P)) is not None:
                stack.cut(at)
            if tag in _CLOSES and (at := stack.find(*_CLOSES[tag])) is not None:
                stack.cut(at)
        if tag not in VOID_TAGS and not token["rest"].rstrip().endswith("/"):
            stack.push(tag, names(token["rest"]) if "=" in token["rest"] or "hidden" in token["rest"] else ())
    put(html[last:])
    flush()
    return out
