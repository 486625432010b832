"""Main text of pages: flat blocks of text, judged by a decision tree over their own and their neighbours' shape.

A page is cut at its block elements into a flat sequence of text blocks. Of a block the tree sees how many words it and
the blocks beside it have, what share of them is linked, and what the elements around it are called. The tree is grown
from the small labelled table below; a page is read in one pass and in time linear in its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm import spans

# -- pages to blocks -----------------------------------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # hold no markup
UNSEEN = RAW | frozenset("head noscript template object svg canvas audio video select button datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
SIDE_TAGS = frozenset("nav aside footer form dialog menu".split())
MAIN_TAGS = frozenset("article main".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
# Words of classes and ids.
MAIN_WORDS = frozenset("article articlebody content maincontent main post entry story".split())
TOP_WORDS = frozenset("header masthead banner".split())  # above an article; inside one they hold its title
SIDE_WORDS = TOP_WORDS | frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer ad ads advert adverts advertisement advertising "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login search share sharing social related recommended trending comment comments disqus "
    "reply replies respond widget toolbar pagination pager copyright disclaimer skip".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
_CLOSED_BY = {  # an open element that a start tag ends, and where the search for it stops
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "a": (("a",), ()),
}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAMED = re.compile(r"class|id|role|hidden|style|itemprop", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=10_000)
def _hints(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's name says main text, or says other text, and whether that is only so above an article."""
    main, side, top = tag in MAIN_TAGS, tag in SIDE_TAGS, tag == "header"
    if tag in ("html", "body") or not _NAMED.search(attributes):
        return main, side, top
    given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
        return False, True, False
    role = given.get("role", "").lower()
    words = {w.lower() for w in _WORDS.findall(f"{given.get('class', '')} {given.get('id', '')}")}
    if words & {"with", "has", "no"}:  # such names say what is beside or missing
        words -= SIDE_WORDS
    named = words & SIDE_WORDS
    if tag in MAIN_TAGS:
        named &= COMMENT_WORDS
    side = side or role in SIDE_ROLES - {"banner"} or bool(named - TOP_WORDS)
    main = main or role == "main" or given.get("itemprop", "").lower() == "articlebody" or bool(words & MAIN_WORDS)
    return main and not named, side, top or role == "banner" or bool(named & TOP_WORDS)


@dataclass
class Blocks:
    """The blocks of a page in order."""

    text: list[str] = field(default_factory=list)
    rows: list[tuple[int, int, bool, bool, bool, bool]] = field(default_factory=list)  # words, linked words, main, side, heading, item


@dataclass
class _Open:
    tag: str
    main: bool
    side: bool
    unseen: bool
    linked: bool
    heading: bool
    item: bool


def page_blocks(page: str) -> Blocks:
    """Text blocks of a page. White space in a block is one space; character references are decoded; blocks without a word are none."""
    out = Blocks()
    root = _Open("", False, False, False, False, False, False)
    stack, counts = [root], {}
    pieces: list[tuple[str, bool]] = []
    place = root  # the block element the pieces belong to

    def flush() -> None:
        if pieces:
            words = " ".join("".join(t for t, _ in pieces).split())
            if words:
                linked = sum(len(t.split()) for t, is_linked in pieces if is_linked)
                total = words.count(" ") + 1
                out.text.append(words)
                out.rows.append((total, min(linked, total), place.main, place.side, place.heading, place.item))
            pieces.clear()

    def pop() -> _Open:
        gone = stack.pop()
        counts[gone.tag] -= 1
        return gone

    def close(tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        if not any(counts.get(t) for t in tags):
            return
        if stops:
            for e in reversed(stack):
                if e.tag in tags:
                    break
                if e.tag in stops:
                    return
        while pop().tag not in tags:
            pass

    def text(a: int, b: int) -> None:
        if b > a and not stack[-1].unseen:
            piece = page[a:b]
            pieces.append((entities.unescape(piece) if "&" in piece else piece, stack[-1].linked))

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(at, end)
            break
        m = _TAG.match(page, lt)
        if m is None:
            after = page[lt + 1 : lt + 2]
            if after in ("!", "?", "/") and after:
                text(at, lt)
                comment = page.startswith("<!--", lt)
                to = page.find("-->" if comment else ">", lt + (2 if comment else 1))
                at = end if to < 0 else to + (3 if comment else 1)
            elif after.isascii() and after.isalpha():  # a tag that never ends
                text(at, lt)
                break
            else:
                text(at, lt + 1)
                at = lt + 1
            continue
        text(at, lt)
        at = m.end()
        ends, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        inline = tag in INLINE
        if not inline:
            flush()
        if ends:
            if counts.get(tag):
                while pop().tag != tag:
                    pass
        elif tag == "br":
            pieces.append((" ", False))
        elif tag not in VOID:
            if not inline:
                close(("p",), ())
            if tag in _CLOSED_BY:
                close(*_CLOSED_BY[tag])
            up = stack[-1]
            main, side, top = _hints(tag, attributes)
            main, side = up.main or main, up.side or side or (top and not up.main)
            if tag in RAW:
                found = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
                at = found.start() if found else end
            unseen = up.unseen or tag in UNSEEN or (inline and side and not up.side)
            heading = up.heading or (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
            stack.append(_Open(tag, main, side, unseen, up.linked or tag == "a", heading, up.item or tag in ("li", "dt", "dd", "td", "th")))
            counts[tag] = counts.get(tag, 0) + 1
        if not inline:
            place = stack[-1]
    flush()
    return out


# -- the tree ------------------------------------------------------------------------------------------------

FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "main", "side", "share of main", "heading", "item")

# Labelled blocks, a page in a line: where (M in an article, S beside one, B beside and in one, - unsaid), what (h heading,
# p paragraph, i item), words/linked words, and + for main text.
LABELLED = """
S:i1/1 S:i1/1 S:i2/2 S:p12/0 M:h10/0+ M:p60/0+ M:p18/0+ M:p3/0+ S:p11/0
S:i2/2 S:i1/1 S:p9/0 M:h2/0+ M:p1/0+ M:p2/0+ M:p90/4+ S:p6/0
S:i1/1 S:p30/0 M:p140/0+ S:p7/1 S:p45/0 S:p3/0
S:p4/4 S:i1/1 M:h7/0+ M:p45/2+ M:p30/0+ M:i12/0+ M:i6/1+ S:h2/0 S:p35/3 B:p50/0 B:p40/0 B:p22/0 S:p14/5
S:i3/3 M:h6/0+ M:p25/10+ M:p8/8+ M:p33/0+ B:p20/0 B:i5/5 M:p2/0+ M:p28/0+ S:p70/6
M:h4/0+ M:p12/0+ M:p3/3+ M:p15/0+ M:i4/4+ M:i2/0+ -:p9/0 -:p14/2 S:p8/0
-:p3/0 -:p25/1 M:h5/0+ M:p70/3+ M:p65/0+ -:h2/0 -:p30/0 -:i4/4 -:p18/0
-:i1/1 -:i2/2 -:p5/0 -:h5/0+ -:p40/0+ -:p38/3+ -:p6/0+ -:p80/0+ -:p10/4 -:p7/7
-:p1/1 -:p1/1 -:p2/2 -:h6/0+ -:p55/2+ -:p70/0+ -:p12/0+ -:p64/1+ -:p3/3 -:p4/4 -:p9/6
-:i4/4 -:i5/5 -:i3/3 -:p120/0+ -:p8/0+ -:p95/3+ -:i5/5 -:i6/6 -:p2/2
-:p2/2 -:p6/6 -:h9/0+ -:p33/0+ -:p28/1+ -:p31/0+ -:p4/0 -:p3/3
S:i1/1 S:i1/1 S:i1/1 S:p20/0 S:p15/15
-:i2/2 -:i2/2 -:p4/0 -:i3/3 -:i2/2
S:p10/0 -:h8/0+ -:p52/0+ -:p47/2+ -:p21/0+ S:i2/2 S:p16/3
S:p160/2 S:p90/0 -:p75/0+ -:p60/2+ -:p24/0+ S:p110/0 S:p13/0
-:p5/5 M:p6/0+ -:p80/0+ -:p75/1+ -:p90/0+ -:p60/2+ -:p4/4
M:h1/0+ M:p1/0+
S:i1/1 M:p5/5+ S:p2/0
-:i1/1 -:i1/1 -:i2/2 -:p14/0 -:h7/0+ -:p44/0+ -:p51/2+ -:p37/0+ -:p12/0 -:i2/2 -:i1/1
-:p3/3 -:p11/2 -:h5/0+ -:p66/0+ -:p5/0+ -:p58/0+ -:p9/0 -:p10/1
-:i2/2 -:i1/1 -:p8/0 -:h4/0+ -:p90/1+ -:p40/0+ -:h3/0+ -:p77/0+ -:p15/2 -:p6/0
S:i1/1 M:h8/0+ M:p50/0+ M:p3/0+ S:p12/0
S:p15/0 M:p80/0+ M:p2/0+ M:p4/0+ M:p70/0+ M:p1/0+ S:p9/0
M:h3/0+ M:p2/0+ M:p40/0+ M:h2/0+ M:p30/0+ M:p3/1+ M:p2/2+ S:p20/0
S:i2/2 M:h5/0+ M:p60/3+ M:i3/0+ M:i2/2+ M:i4/0+ M:p55/0+ M:p4/4+ S:p3/3
-:h7/0+ -:p48/0+
"""
_ENTRY = re.compile(r"([MSB-]):([hpi])(\d+)/(\d+)(\+?)")


def features(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows: words, linked words, main, side, heading, item of the blocks of many pages, page p from first[p] to first[p + 1]."""
    words, linked, main, side = rows[:, 0].astype(float), rows[:, 1], rows[:, 2], rows[:, 3]
    density = linked / np.maximum(words, 1)
    begins, ends = np.zeros(len(rows) + 1, bool), np.zeros(len(rows) + 1, bool)
    begins[first[:-1]], ends[first[1:] - 1] = True, True
    begins, ends = begins[: len(rows)], ends[: len(rows)]

    def beside(x: np.ndarray, by: int, border: np.ndarray) -> np.ndarray:
        return np.where(border, 0, np.roll(x, by))

    def per_page(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return np.repeat(total[first[1:]] - total[first[:-1]], np.diff(first))

    open_words = words * (side == 0)
    share = per_page(open_words * main) / np.maximum(per_page(open_words), 1)
    return np.column_stack([words, density, beside(words, 1, begins), beside(density, 1, begins), beside(words, -1, ends), beside(density, -1, ends), main, side, share, rows[:, 4], rows[:, 5]])


@dataclass
class Tree:
    """Node i asks whether a feature is at most a threshold and goes on at left or right; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    good: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.good[at]
            node = at[inner]
            at[inner] = np.where(x[inner, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 1) -> Tree:
    """Each node takes the split of least Gini impurity (of equals the first feature, the lowest threshold) until it is pure."""
    nodes: list[list[float]] = []

    def node(rows: np.ndarray, level: int) -> int:
        here = len(nodes)
        n, good = len(rows), int(y[rows].sum())
        nodes.append([-1, 0.0, 0, 0, good * 2 > n])
        best = (good * (n - good) / n - 1e-12, -1, 0.0)
        if level < depth and 0 < good < n:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                value, ones = x[order, f], np.cumsum(y[order])
                size = np.arange(1, n)
                a, b = ones[:-1], good - ones[:-1]
                impurity = a * (size - a) / size + b * (n - size - b) / (n - size)
                impurity[(value[1:] == value[:-1]) | (size < least) | (n - size < least)] = np.inf
                i = int(impurity.argmin()) if n > 1 else 0
                if n > 1 and impurity[i] < best[0] - 1e-12:
                    best = (float(impurity[i]), f, float(value[i] + value[i + 1]) / 2)
        if best[1] >= 0:
            _, f, cut = best
            low = x[rows, f] <= cut
            nodes[here][:4] = [f, cut, node(rows[low], level + 1), node(rows[~low], level + 1)]
        return here

    node(np.arange(len(x)), 0)
    feature, threshold, left, right, good = zip(*nodes, strict=True)
    return Tree(np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64), np.array(good, bool))


def labelled_blocks(table: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a labelled table."""
    pages = [_ENTRY.findall(line) for line in table.strip().splitlines()]
    rows = [(int(w), int(k), where in "MB", where in "SB", what == "h", what == "i") for page in pages for where, what, w, k, _ in page]
    first = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    return features(np.array(rows, np.int64), first), np.array([g == "+" for page in pages for *_, g in page], np.int64)


def texts_of(pages: list[str | None], tree: Tree) -> list[str]:
    found = [page_blocks(p or "") for p in pages]
    first = np.concatenate([[0], np.cumsum([len(b.text) for b in found])])
    if not first[-1]:
        return [""] * len(pages)
    good = tree.predict(features(np.array([r for b in found for r in b.rows], np.int64), first))
    return ["\n\n".join(t for t, g in zip(b.text, good[a:], strict=False) if g) for b, a in zip(found, first.tolist(), strict=False)]


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, url, text, n_chars (code points), a row for each input row.

    The text is that of the page's main blocks in order, joined by blank lines; empty for null, empty and blockless pages.
    Scripts, styles, comments, forms' controls and hidden elements hold no text. Broken markup is read as browsers do
    where it is simple: an unended comment, script or tag takes the rest of the page, an unended quote only its tag, an
    unended element ends with the one around it, ``<`` before anything else is text. Pages are read whole, whatever their length. Repeated rows stay apart;
    other columns are not read. Without ``tree`` it is grown from the labelled table.
    """
    tree = tree or grow(*labelled_blocks())
    sent = pages.sparkSession.sparkContext.broadcast(tree)  # some dozen nodes

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "html"):
                text = texts_of(part.column("html").to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(step, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
