"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each block is main text or not. A block's score is the sum of the weights of its features: tags and
class words of its ancestors, the innermost telling one among them, its own tag, length, links and
punctuation. Neighbouring labels have transition weights, and Viterbi finds the best labelling of a page.
Weights are fitted to labelled pages by gradient steps on the conditional likelihood.

Pages are labelled here by construction: ``labelled_pages`` builds ``FIT_PAGES`` pages of many layouts
whose main text is known. Other labelled pages can be passed to ``fit``. No features of a site or a
language are used. Extraction itself is one Arrow pass over whole pages, without a shuffle.

Defined cases: null and empty pages, and pages without main text, give an empty text; broken or
unclosed markup is read as browsers do for the common cases; repeated rows are extracted each; an
empty table stays empty; only the columns in ``keep`` come along.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfmark.llm.html_blocks import Block, Node, blocks

#: Labelled pages the model is fitted on, passes over them, step size and weight decay.
FIT_PAGES = 400
FIT_PASSES = 8
STEP = 0.3
DECAY = 1e-4

# Tags that say nothing by themselves; the innermost telling ancestor is another one.
_PLAIN = frozenset("html body div span p b i em strong a u small font center table tbody thead tr td th ul ol li "
                   "dl dt dd section blockquote h1 h2 h3 h4 h5 h6 pre code figure".split())


def _context(node: Node | None, known: dict | None) -> tuple[frozenset, tuple, tuple, str]:
    """Of an element and its ancestors: names of features, those of the two innermost telling ones, own tag.

    Worked out once per element, from that of its parent.
    """
    fresh = []
    while node is not None and (node.context is None or node.context[0] is not known):
        fresh.append(node)
        node = node.parent
    held = (frozenset(), (), (), "") if node is None else node.context[1]
    for node in reversed(fresh):
        found, inner, outer, tag = held
        own = [f"name {w}" for w in node.names if known is None or f"name {w}" in known]
        own += [f"in {node.tag}"] if node.tag not in _PLAIN else []
        more = {x for x in (f"in {node.tag}", *own) if (known is None or x in known) and x not in found}
        if own:
            outer, inner = inner, tuple(own)
        held = (found | more if more else found, inner, outer,
                tag if node.tag in ("a", "b", "i", "em", "strong", "span", "font") else node.tag)
        node.context = (known, held)
    return held


def features(block: Block, known: dict | None) -> list[str]:
    """Feature names of one block; ``known`` limits those of its ancestors to the ones seen in fitting."""
    found, inner, outer, own = _context(block.node, known)
    out = set(found)
    out.update(f"inner {x}" for x in inner)
    out.update(f"inner {x} of {y}" for x in inner for y in outer if x.startswith("in ") and y.startswith("in "))
    n = block.text.count(" ") + 1
    size = "1" if n == 1 else "2-3" if n < 4 else "4-9" if n < 10 else "10-24" if n < 25 else "25+"
    links = "no" if block.linked == 0 else "some" if block.linked < 0.4 else "most"
    out |= {f"tag {own}", f"words {size}", f"links {links}", f"words {size} links {links}", f"tag {own} links {links}",
            f"ends {'.' if block.text[-1] in '.!?' else '-'}", f"heading {min(block.after, 2)}", "any"}
    if block.text[0] in "©®":
        out.add("sign")
    return sorted(out)


class Model:
    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def score(self, block: Block) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(block, self.weights))

    def labels(self, page: Sequence[Block]) -> list[bool]:
        """Viterbi over the two labels; only the main-text label has feature weights."""
        if not page:
            return []
        (stay_no, to_yes), (to_no, stay_yes) = self.moves.tolist()
        no, yes, back = 0.0, self.score(page[0]), []
        for block in page[1:]:
            from_yes = (yes + to_no > no + stay_no, yes + stay_yes > no + to_yes)
            no, yes = (max(no + stay_no, yes + to_no), max(no + to_yes, yes + stay_yes) + self.score(block))
            back.append(from_yes)
        out = [yes > no]
        for from_yes in reversed(back):
            out.append(from_yes[out[-1]])
        return out[::-1]

    def text(self, html: str | None) -> str:
        page = blocks(html)
        return "\n\n".join(b.text for b, main in zip(page, self.labels(page)) if main)


def fit(pages: Iterable[tuple[str, Sequence[bool]]], passes: int = FIT_PASSES, seed: int = 1) -> Model:
    """From (html, label of each block): AdaGrad steps page by page, gradients by forward-backward."""
    parsed = [([features(b, None) for b in blocks(html)], np.array(labels, int)) for html, labels in pages]
    index = {f: n for n, f in enumerate(sorted({f for rows, _ in parsed for r in rows for f in r}))}
    coded = [([np.array([index[f] for f in r]) for r in rows], y) for rows, y in parsed if rows]
    w, seen = np.zeros(len(index)), np.full(len(index), 1e-6)
    moves, moved = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    order = random.Random(seed)
    for _ in range(passes):
        order.shuffle(coded)
        for rows, y in coded:
            local = np.zeros((len(rows), 2))
            local[:, 1] = [w[r].sum() for r in rows]
            near, pairs = _marginals(local, moves)
            wrong = near[:, 1] - y
            at, by = np.concatenate(rows), np.repeat(wrong, [len(r) for r in rows])
            touched, slot = np.unique(at, return_inverse=True)
            g = np.bincount(slot, by) + DECAY * w[touched]
            seen[touched] += g * g
            w[touched] -= STEP * g / np.sqrt(seen[touched])
            gm = pairs + DECAY * moves
            np.subtract.at(gm, (y[:-1], y[1:]), 1)
            moved += gm * gm
            moves -= STEP * gm / np.sqrt(moved)
    return Model({f: float(w[n]) for f, n in index.items()}, moves)


def _marginals(local: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each label and, summed, of each pair of neighbouring labels."""
    n, m = len(local), np.exp(moves - moves.max())
    e = np.exp(local - local.max(axis=1, keepdims=True))
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    forward[0] = e[0] / e[0].sum()
    for t in range(1, n):
        f = (forward[t - 1] @ m) * e[t]
        forward[t] = f / f.sum()
    for t in range(n - 2, -1, -1):
        b = m @ (e[t + 1] * backward[t + 1])
        backward[t] = b / b.sum()
    near = forward * backward
    near /= near.sum(axis=1, keepdims=True)
    pairs = forward[:-1, :, None] * m * (e[1:] * backward[1:])[:, None, :]
    return near, (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if n > 1 else np.zeros((2, 2))


def extract(pages: DataFrame, model: Model, *, html: str = "html",
            keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, text and n_chars of every page."""
    keep = list(keep)

    def run(batches):
        for batch in batches:
            texts = [model.text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], out)

    schema = StructType([pages.schema[c] for c in keep]
                        + [StructField("text", StringType()), StructField("n_chars", LongType())])
    out = schema.names
    return pages.select(*keep, pages[html].alias("html to read")).mapInArrow(run, schema)


# Words that page authors use in class and id names, by role; the label follows from the role.
_ROLES = {
    "main": "content article post entry story body text main page single prose blog article-body post-content "
            "entry-content story-body main-content content-body article-text rich-text post-body".split(),
    "nav": "nav menu navbar main-nav site-nav navigation breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "header": "header site-header masthead topbar top-bar page-header brand logo branding tagline".split(),
    "footer": "footer site-footer page-footer bottom copyright colophon legal footer-links".split(),
    "side": "sidebar aside widget widget-area rail right-rail side related related-posts recommended popular trending "
            "most-read teaser more-stories latest promo-box".split(),
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice notification alert announcement popup modal "
              "overlay message privacy-notice warning paywall".split(),
    "ad": "ad ads advert advertisement ad-slot sponsored sponsor promo promotion banner ad-container adbox dfp".split(),
    "form": "form search search-form login signup newsletter subscribe contact-form subscription".split(),
    "comment": "comments comment comment-list respond replies reply discussion disqus responses feedback reader-comments "
               "user-comments".split(),
    "share": "share social share-buttons social-links sharing toolbar print-tools tags tag-list".split()}


def labelled_pages(count: int = FIT_PAGES, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Pages of many layouts with the label of each block, built from invented words."""
    return [_Maker(random.Random(seed * 1_000_003 + n)).page() for n in range(count)]


class _Maker:
    def __init__(self, r: random.Random):
        self.r, self.main, self.other = r, set(), set()

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, low: int, high: int) -> str:
        syllables = "ka to mi re sol ban der il en qu ost ple ra ti na vo".split()
        word = lambda: "".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 4)))
        return " ".join(word() for _ in range(self.r.randint(low, high))).capitalize()

    def say(self, low: int, high: int, main: bool, stop: float = 0.9) -> str:
        """New words, remembered under their label."""
        while True:
            text = self.words(low, high) + ("." if self.chance(stop) else "")
            if text not in self.main and text not in self.other:
                (self.main if main else self.other).add(text)
                return text

    def name(self, role: str, p: float = 0.85) -> str:
        if not self.chance(p):
            return f' class="x{self.r.randint(1, 99)}"' if self.chance(0.5) else ""
        kind = self.r.choice(["class", "class", "id"])
        extra = f" c{self.r.randint(1, 9)}" if kind == "class" and self.chance(0.2) else ""
        return f' {kind}="{self.r.choice(_ROLES[role])}{extra}"'

    def links(self, low: int, high: int) -> str:
        one = lambda: f'<a href="/x">{self.say(1, 4, False, 0)}</a>'
        n = self.r.randint(low, high)
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
        return "".join(f"<p>{one()}</p>" for _ in range(n)) if self.chance(0.4) else "<div>" + " | ".join(one() for _ in range(1)) + "</div>"

    def prose(self, n: int, main: bool) -> str:
        def one() -> str:
            kind, close = self.r.random(), self.r.choice(["</p>", "</p>", ""])
            if main and kind < 0.08:
                return f"<{(h := self.r.choice(['h2', 'h3']))}>{self.say(2, 8, True, 0)}</{h}>"
            if main and kind < 0.14:
                return "<ul>" + "".join(f"<li>{self.say(2, 15, True, 0.4)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
            if main and kind < 0.18:
                return f"<blockquote><p>{self.say(5, 30, True)}</p></blockquote>"
            if main and kind < 0.21:
                return "<table>" + "".join(f"<tr><td>{self.say(1, 3, True, 0)}</td><td>{self.say(1, 6, True, 0)}</td></tr>"
                                           for _ in range(2)) + "</table>"
            if kind < 0.4:
                return f"<p>{self.say(1, 4, main)}{close}"
            return f"<p>{self.say(8, 80, main)}{close}"
        return "".join(one() for _ in range(n))

    def box(self, role: str, inside: str, tags: Sequence[str], p: float = 0.85) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.name(role, p if tag in ('div', 'section', 'ul') else 0.4)}>{inside}</{tag}>"

    def extra(self, role: str) -> str:
        """A part that is not main text, with much or little prose in it."""
        text = lambda: self.prose(self.r.randint(1, 3), False)
        head = f"<{(h := self.r.choice(['h2', 'h3', 'h4', 'strong']))}>{self.say(1, 4, False, 0)}</{h}>" if self.chance(0.5) else ""
        if role == "nav":
            return self.box("nav", self.links(2, 7), ["nav", "nav", "div", "ul"], 1)
        if role == "header":
            inside = f"<{(h := self.r.choice(['h1', 'div', 'p', 'a']))}>{self.say(1, 4, False, 0)}</{h}>"
            return self.box("header", inside + (self.extra("nav") if self.chance(0.6) else ""), ["header", "header", "div"], 1)
        if role == "footer":
            inside = self.r.choice(["&copy; ", "", "© 2020 "]) + self.say(2, 25, False)
            inside += self.links(1, 4) if self.chance(0.4) else ""
            return self.box("footer", inside, ["footer", "footer", "div"], 1)
        if role == "side":
            inside = head + (self.links(2, 6) if self.chance(0.6) else text())
            return self.box("side", inside, ["aside", "aside", "div", "section"], 1)
        if role == "form":
            inside = head + f"<label>{self.say(1, 3, False, 0)}</label><input name=q><button>{self.say(1, 2, False, 0)}</button>"
            inside += f"<p>{self.say(4, 20, False)}</p>" if self.chance(0.4) else ""
            inside += f"<select><option>{self.say(1, 2, False, 0)}<option>{self.say(1, 2, False, 0)}</select>" if self.chance(0.2) else ""
            return self.box("form", inside, ["form", "form", "form", "div"], 1)
        if role == "comment":
            one = lambda: f"<{(t := self.r.choice(['li', 'div', 'article']))}{self.name('comment', 0.6)}>{text()}</{t}>"
            return self.box("comment", head + "".join(one() for _ in range(self.r.randint(1, 4))), ["div", "section", "ol"], 1)
        if role == "share":
            return self.box("share", self.links(1, 4), ["div", "ul", "p"], 1)
        inside = head + (text() if self.chance(0.6) else self.say(2, 25, False))
        return self.box(role, inside, ["div", "div", "section", "aside" if role == "ad" else "div"], 1)

    def page(self) -> tuple[str, list[bool]]:
        r = self.r
        title = self.say(3, 12, True, 0.2)
        heading = f"<h1>{title}</h1>" if self.chance(0.9) else f"<h2>{title}</h2>"
        if self.chance(0.25):
            heading = f"<header>{heading}</header>"
        body = [self.prose(1, True) for _ in range(r.randint(1, 9))]
        for role, p in (("ad", 0.25), ("side", 0.2), ("share", 0.25), ("form", 0.15), ("comment", 0.12), ("nav", 0.1), ("notice", 0.12)):
            if self.chance(p):
                body.insert(len(body) if role == "comment" else r.randint(0, len(body)), self.extra(role))
        inside = heading + "".join(body)
        kind = r.random()
        if kind < 0.45:
            inside = f"<article{self.name('main', 0.4)}>{inside}</article>"
        elif kind < 0.6:
            inside = f"<main{self.name('main', 0.4)}>{inside}</main>"
        elif kind < 0.9:
            inside = f"<div{self.name('main', 1)}>{inside}</div>"
        else:
            inside = f"<div>{inside}</div>"
        if self.chance(0.3):
            inside = f"<{(t := r.choice(['main', 'section', 'div']))}{self.name('main', 0.5)}>{inside}</{t}>"
        before = [self.extra(x) for x, p in (("notice", 0.35), ("header", 0.6), ("nav", 0.7), ("ad", 0.4), ("side", 0.2), ("form", 0.2)) if self.chance(p)]
        after = [self.extra(x) for x, p in (("share", 0.2), ("comment", 0.4), ("side", 0.4), ("ad", 0.3), ("form", 0.3), ("notice", 0.2), ("nav", 0.2)) if self.chance(p)]
        r.shuffle(before)
        r.shuffle(after)
        if self.chance(0.9):
            after.append(self.extra("footer"))
        html = ('<!DOCTYPE html><html><head><title>x</title><script>var a="</p>";</script></head><body>'
                + "".join(before) + inside + "".join(after) + ("</body></html>" if self.chance(0.8) else ""))
        return html, [b.text in self.main for b in blocks(html)]
