"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of elements. Each element has features: its own and its subtree's text and links per tag,
depth, place and share among its siblings, which group its tag belongs to, and how far the words of its
class, id and role attributes name a part of the frame or content; an element with most of the page's prose isn't named away. Boosted trees give each element the log-odds of being main text. They are
trained on elements of a bounded sample of pages that page authors have named plainly, by tag or attribute:
those names make the labels, and the trees carry them over to elements by shape and surroundings. As the pages of one
site look alike, each is also learnt from in variants: its own sentences stand in sidebars, notices, adverts
and comments in and around the article, and the article is named in other ways or not at all.

Hierarchical decoding then picks the set of kept elements with the greatest sum of log-odds, weighted by text, under
the rule that an element within a dropped one is dropped; elements that hold no rendered text (head, script,
style, forms and the like) are dropped by definition. So no paragraph outlives the sidebar around it, and no
menu within an article stays for being in an article.

The sample is the ``TRAIN_PAGES`` pages of least hash of page_id, those without an id left out; the driver holds
their elements' features only.
Every whole page is read where it lies.

Defined cases: null and empty pages give the empty text; unclosed and stray tags are closed where HTML closes
them; text of an element left open runs to the end; repeated rows give a row each; an empty table none, and
without training elements the names decide alone; columns other than page_id, url and html are ignored, whatever
their names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stagewatch.llm.common import slices, table, texts
from stagewatch.llm.registry import query

TRAIN_PAGES = 500
TREES, DEPTH, RATE, SPLITS = 30, 3, 0.3, 32

# HTML's elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
HIDDEN = RAW | frozenset("head form button select option input svg canvas object audio video dialog menu datalist fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Opening one of these closes an open paragraph.
ENDS_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr li dd dt summary figcaption".split())
CLOSES_OWN = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
GROUPS = ("content", "heading", "text", "list", "table", "container", "inline", "frame", "other")
TAG_GROUP = {
    **dict.fromkeys(("article", "main"), "content"),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), "heading"),
    **dict.fromkeys(("p", "pre", "blockquote", "figure", "figcaption"), "text"),
    **dict.fromkeys(("ul", "ol", "li", "dl", "dt", "dd"), "list"),
    **dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "table"),
    **dict.fromkeys(("div", "section", "body", "html", "center"), "container"),
    **dict.fromkeys(("b", "i", "em", "strong", "span", "a", "u", "small", "code", "sub", "sup", "mark", "q", "cite", "abbr", "time", "s", "font"), "inline"),
    **dict.fromkeys(("nav", "footer", "header", "aside"), "frame"),
}
NEGATIVE = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer foot header masthead sidebar side aside widget related recommended share sharing social cookie cookies consent notice gdpr "
    "alert popup modal overlay newsletter subscribe subscription signup login search comment comments comentarios respond reply replies "
    "discussion disqus toolbar pagination pager tags tagcloud copyright legal skip toc hidden meta byline rss".split()
)
POSITIVE = frozenset("article content post entry story main text body prose".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")  # attributes, quoted values whole
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
#: One attribute whole: its name, then its value quoted or bare.
_ATTRIBUTE = re.compile(r"""([^\s>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    place: int  # among its parent's elements
    attributes: str
    hidden: bool
    own: int = 0  # characters of text directly within
    children: int = 0
    begin: int = 0  # offsets of its opening markup, of its inside, and of its closing markup
    inner: int = 0
    end: int = 0
    after: int = 0


@dataclass(slots=True)
class Page:
    nodes: list[Node]
    pieces: list[tuple[int, str | None]]  # text with its node, None where a block begins or ends


class Stack:
    """Open elements, with the depths at which each tag stands open, so that none is looked for in vain."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.open, self.depths = nodes, [0], {}

    def push(self, k: int) -> None:
        self.depths.setdefault(self.nodes[k].tag, []).append(len(self.open))
        self.open.append(k)

    def pop(self) -> Node:
        node = self.nodes[self.open.pop()]
        self.depths[node.tag].pop()
        return node

    def last(self, tags: Iterable[str]) -> int:
        """Depth of the innermost open element among ``tags``, 0 if none is."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def first_above(self, tags: Iterable[str], border: int) -> int | None:
        """Depth of the outermost open element among ``tags`` that stands above ``border``."""
        found = [d[k] for t in tags if (d := self.depths.get(t)) and (k := bisect_right(d, border)) < len(d)]
        return min(found, default=None)


def _markup(source: str, loose: bool) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, tag, attributes) of each tag from the point that was sent, and of other markup with no tag.

    A tag whose quotes never close would swallow the page: from there on tags end at the first ``>``, quoted or not.
    """
    at = source.find("<")
    while at >= 0:
        m, sent = _TAG.match(source, at), None
        if m:
            end = m.end()
            if not loose:
                end = _INSIDE.match(source, end).end()
                loose = end >= len(source)
            if loose:
                end = source.find(">", m.end())
                if end < 0:
                    return  # no tag ends any more
            sent = yield at, end + 1, m[1], m[2].lower(), source[m.end() : end]
            at = end + 1
        elif m := _MARK.match(source, at):
            sent = yield at, m.end(), "", "", ""
            at = m.end()
        else:
            at += 1
        at = source.find("<", at if sent is None else sent)


def parse(source: str) -> Page:
    """Elements in page order and the text between their borders; the time it takes grows with the page's length only."""
    nodes = [Node("", -1, 0, 0, "", False)]
    pieces: list[tuple[int, str | None]] = []
    stack, at = Stack(nodes), 0

    def add(text: str) -> None:
        if text:
            nodes[stack.open[-1]].own += len(text.strip())
            pieces.append((stack.open[-1], text))

    def close(to: int, end: int, after: int) -> None:
        """Close the elements from a depth on; the outermost one's closing markup is given."""
        while len(stack.open) > to:
            node = stack.pop()
            node.end, node.after = end, (after if len(stack.open) == to else end)
            if node.tag in BLOCKS:
                pieces.append((stack.open[-1], None))

    markup, go_on = _markup(source, False), None
    while True:
        try:
            start, end, slash, tag, attributes = markup.send(go_on)
        except StopIteration:
            break
        go_on = None
        add(source[at:start])
        at = end
        if not tag:
            continue
        if slash:
            border = 0 if tag in ("body", "html") else stack.last(("table", "body"))
            k = stack.last((tag,))
            if k and k >= border:
                close(k, start, end)
            if tag == "p" or tag in BLOCKS:
                pieces.append((stack.open[-1], None))
            continue
        if tag in ENDS_P:
            k = stack.first_above(("p",), stack.last(("table", "button", "object")))
            if k:
                # Inline elements opened within end with the paragraph.
                close(k, start, start)
        if tag in CLOSES_OWN:
            own, borders = CLOSES_OWN[tag]
            k = stack.first_above(own, stack.last(borders))
            if k:
                close(k, start, start)
        if tag in BLOCKS or tag in ("br", "hr"):
            # A line break is white space inside a block; a block ends where another begins.
            pieces.append((stack.open[-1], "\n" if tag == "br" else None))
        if tag in VOID:
            continue
        up = nodes[stack.open[-1]]
        up.children += 1
        node = Node(tag, stack.open[-1], up.depth + 1, up.children, attributes, tag in HIDDEN or _unseen(attributes), begin=start, inner=end, end=end, after=end)
        nodes.append(node)
        if tag in RAW:  # its text is no markup and not shown
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)|\Z", re.I).search(source, at)
            node.end, node.after = closing.span()
            at = go_on = closing.end()
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCKS and tag not in TAG_GROUP:
            continue
        stack.push(len(nodes) - 1)
    add(source[at:])
    close(1, len(source), len(source))
    return Page(nodes, pieces)


def _attributes(source: str) -> Iterator[tuple[str, str]]:
    """(name, value) of each attribute, the first of a name; values are never searched for names."""
    given = set()
    for m in _ATTRIBUTE.finditer(source):
        name = m[1].lower()
        if name not in given:
            given.add(name)
            yield name, m[2] or m[3] or m[4] or ""


def _unseen(attributes: str) -> bool:
    if not attributes:
        return False
    for name, value in _attributes(attributes):
        value = value.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


#: Share of a name's words from which it names a part of the frame.
PLAINLY = 0.5


def _named(node: Node) -> tuple[float, float, int]:
    """How far class and id name a part of the page's frame, and content, and whether the role is of a frame part.

    A name is a class or an id; of its words the share that is in the list counts, of several names the greatest
    share. A frame is named plainly or not at all: ``comment-list`` names one by half of its words,
    ``news-about-comments`` none.
    """
    bad = good = 0.0
    role = 0
    if node.attributes:
        for name, value in _attributes(node.attributes):
            if name == "role":
                words = {w.lower() for w in _WORDS.findall(value)}
                role = -1 if words & ROLES_OUT else int("main" in words or "article" in words)
            elif name in ("class", "id"):
                for one in value.split():
                    words = [w.lower() for w in _WORDS.findall(one)]
                    if words:
                        bad = max(bad, sum(w in NEGATIVE for w in words) / len(words))
                        good = max(good, sum(w in POSITIVE for w in words) / len(words))
    return (bad if bad >= PLAINLY else 0.0), good, role


FEATURES = (
    "bad",
    "good",
    "role",
    "up_bad",
    "up_frame",
    "up_content",
    "up_role",
    "up_good",
    "depth",
    "place",
    "siblings",
    "text",
    "share",
    "density",
    "links",
    "sibling_text",
    "paragraphs",
    *GROUPS,
)


#: A part that holds so much of the page's unlinked text isn't named away.
PROSE_SHARE = 0.5


def features(page: Page) -> np.ndarray:
    """A row of ``FEATURES`` for each element, the unnamed root first."""
    nodes = page.nodes
    n = len(nodes)
    parent = [x.parent for x in nodes]
    text = [0 if x.hidden else x.own for x in nodes]
    linked, elements, paragraphs = [0] * n, [1] * n, [int(x.tag == "p") for x in nodes]
    for k in range(n - 1, 0, -1):  # children stand behind their parents
        up = parent[k]
        if nodes[k].tag == "a":
            linked[k] = text[k]
        text[up] += text[k]
        linked[up] += linked[k]
        elements[up] += elements[k]
        paragraphs[up] += paragraphs[k]
    total, prose = max(1, text[0]), max(1, text[0] - linked[0])
    up_bad, up_frame, up_content, up_role, up_good = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n, [0.0] * n
    own: list[tuple[float, float, int]] = []
    group = [0] * n
    for k, node in enumerate(nodes):
        bad, good, role = _named(node)
        if bad and (text[k] - linked[k]) > PROSE_SHARE * prose:
            bad = 0.0
        own.append((bad, good, role))
        kind = TAG_GROUP.get(node.tag, "other")
        if k:
            up = parent[k]
            above = nodes[up].tag
            up_bad[k] = up_bad[up] + own[up][0]
            up_frame[k] = max(up_frame[up], float(above in ("nav", "footer", "aside") or above == "header" and not up_content[up]))
            up_content[k] = max(up_content[up], float(above in ("article", "main")))
            up_role[k] = up_role[up] or own[up][2]
            up_good[k] = up_good[up] + (own[up][1] > own[up][0])
            if node.tag == "header" and up_content[k]:  # an article's own heading
                kind = "container"
        group[k] = GROUPS.index(kind)
    text_, up_ = np.array(text, float), np.array([0, *parent[1:]])
    children, paragraphs_ = np.array([x.children for x in nodes], float), np.array(paragraphs, float)
    siblings, of_parent = children[up_], text_ / np.maximum(1.0, text_[up_])
    siblings[0], of_parent[0] = 1, 1
    columns = [
        *np.array(own, float).T, up_bad, up_frame, up_content, up_role, up_good, [x.depth for x in nodes], [x.place for x in nodes], siblings,
        np.log1p(text_), text_ / total, np.log1p(text_ / np.array(elements)), np.array(linked) / np.maximum(1.0, text_), of_parent, np.log1p(paragraphs_),
    ]
    out = np.zeros((n, len(FEATURES)))
    out[:, : len(columns)] = np.array(columns, float).T
    out[np.arange(n), len(columns) + np.array(group)] = 1
    return out


def plain_labels(page: Page, rows: np.ndarray) -> np.ndarray:
    """1 and 0 where an author's names say what an element is, by itself or by an element around it; else -1.

    On a page that names no content, what is not named otherwise is content.
    """
    column = {name: rows[:, k] for k, name in enumerate(FEATURES)}
    tag = np.array([x.tag for x in page.nodes])
    content = np.isin(tag, ("article", "main")) | (column["role"] > 0) | (column["good"] > column["bad"])
    inside = content | (column["up_content"] > 0) | (column["up_role"] > 0) | (column["up_good"] > 0)
    framed = np.isin(tag, ("nav", "footer", "aside")) | ((tag == "header") & (column["up_content"] == 0))
    framed |= (column["role"] < 0) | (column["up_role"] < 0)
    framed |= (column["bad"] > column["good"]) & ~np.isin(tag, ("body", "html", "article", "main"))
    for k in range(1, len(page.nodes)):  # what lies in a named part belongs to it
        framed[k] |= framed[page.nodes[k].parent]
    out = np.full(len(tag), -1)
    out[inside if content.any() else column["depth"] > 0] = 1
    out[np.isin(tag, ("", "html", "body", "head"))] = -1
    out[framed] = 0
    return out


#: Parts put into variants of a page: opening and closing markup around sentences of its own.
FRAMES = [
    *[(f'<div class="{w}">', "</div>") for w in ("ad", "sidebar", "cookie-notice", "related", "newsletter-signup", "share-buttons", "breadcrumbs", "promo-box")],
    *[(f'<section id="{w}"><h2>', "</h2><p>{0}</p></section>") for w in ("comments", "related-posts", "respond")],
    ('<div class="comment-list"><div><p>', "</p><p>{0}</p></div></div>"),
    ("<aside><p>", "</p></aside>"),
    ("<nav><a href=x>", "</a></nav>"),
    ('<ul class="menu"><li>', "</li><li>{0}</li></ul>"),
    ('<p class="notice">', "</p>"),
    ('<div role="banner">', "</div>"),
    ("<footer><p>", "</p></footer>"),
]
#: Pages are dealt to this many ways of making variants: all pairings of first frame and content name come up.
VARIANTS = 2520
CONTENT_NAMES = [
    ("article", "article"), ("main", "main"), ('div class="post-content"', "div"), ('div id="content"', "div"), ("div", "div"), ('section class="entry"', "section"),
    ('article class="notes-about-the-comments"', "article"), ('div class="text-on-menu-and-search"', "div"),
]
#: Names of parts of an article; a word of theirs may be that of a frame.
PART_NAMES = ["<div>", '<div class="day-of-the-menu">', '<section id="results-of-our-search">', '<div class="part">']


def content_of(page: Page) -> int | None:
    """The element that an author has named as the page's content, with the most text."""
    text = [0 if x.hidden else x.own for x in page.nodes]
    for k in range(len(text) - 1, 0, -1):
        text[page.nodes[k].parent] += text[k]
    best = None
    for k, node in enumerate(page.nodes):
        if k and node.tag not in ("html", "body") and not node.hidden:
            bad, good, role = _named(node)
            if (node.tag in ("article", "main") or role > 0 or good > bad) and (best is None or text[k] > text[best]):
                best = k
    return best


def variants(source: str, number: int) -> list[str]:
    """The page, and two versions with further parts in and around its content, which is named in another way."""
    page = parse(source)
    found = content_of(page)
    if found is None:
        return [source]
    node = page.nodes[found]
    sentences = [s for k, t in page.pieces if t and page.nodes[k].tag == "p" for s in [t.strip()[:400]] if len(s) >= 20] or ["Text."]
    out = [source]
    for v in range(2):
        k = 2 * number + v
        opening, closing = CONTENT_NAMES[k % len(CONTENT_NAMES)]
        part = [FRAMES[(k * 5 + j * 7) % len(FRAMES)] for j in range(4)]
        made = [a + sentences[(k + j) % len(sentences)] + b.format(sentences[(k + j + 1) % len(sentences)]) for j, (a, b) in enumerate(part)]
        own = PART_NAMES[k % len(PART_NAMES)]
        inside = source[node.inner : node.end]
        if k % 5 == 0:  # the content's parts have a wrapper of their own
            inside = own + inside + ("</section>" if own.startswith("<section") else "</div>")
        out.append(
            f"{source[: node.begin]}{made[0]}<{opening}>{'' if k % 3 else made[1]}{inside}"
            f"{made[2] if k % 2 else ''}</{closing}>{made[3]}{source[node.after :]}"
        )
    return out


@dataclass
class Forest:
    """Boosted trees of depth ``DEPTH``: each a complete tree of splits (column, bound), and leaf values."""

    start: float
    columns: np.ndarray  # (trees, inner nodes)
    bounds: np.ndarray
    leaves: np.ndarray  # (trees, leaves)

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        for columns, bounds, leaves in zip(self.columns, self.bounds, self.leaves, strict=True):
            at = np.zeros(len(rows), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[every, columns[at]] > bounds[at])
            out += leaves[at - len(columns)]
        return out


def boost(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Forest:
    """Gradient boosting by Newton steps on the logistic loss, with splits at quantiles."""
    mean = float(np.clip((labels * weights).sum() / weights.sum(), 1e-3, 1 - 1e-3))
    start = np.log(mean / (1 - mean))
    total = np.full(len(rows), start)
    cuts = [np.unique(np.quantile(rows[:, c], np.linspace(0, 1, SPLITS))) for c in range(rows.shape[1])]
    columns, bounds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = weights * (labels - p), weights * p * (1 - p)
        inner = 2**DEPTH - 1
        column, bound = np.zeros(inner, int), np.full(inner, np.inf)
        at = np.zeros(len(rows), int)
        for level in range(DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                here = at == node
                if here.sum() > 1:
                    column[node], bound[node] = _split(rows[here], g[here], h[here], cuts)
            at = 2 * at + 1 + (rows[np.arange(len(rows)), column[at]] > bound[at])
        value = np.zeros(inner + 1)
        for leaf in range(inner + 1):
            here = at == inner + leaf
            value[leaf] = RATE * g[here].sum() / (h[here].sum() + 1.0)
        total += value[at - inner]
        columns.append(column)
        bounds.append(bound)
        leaves.append(value)
    return Forest(start, np.array(columns), np.array(bounds), np.array(leaves))


def _split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
    """Column and bound of the greatest gain; an infinite bound sends all rows left."""
    best, choice = 1e-6, (0, np.inf)
    all_g, all_h = g.sum(), h.sum()
    for c, values in enumerate(cuts):
        if len(values) < 2:
            continue
        at = np.searchsorted(values, rows[:, c])  # in bin k: at most values[k]
        left_g = np.cumsum(np.bincount(at, g, len(values)))[:-1]
        left_h = np.cumsum(np.bincount(at, h, len(values)))[:-1]
        gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, choice = gain[k], (c, float(values[k]))
    return choice


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which elements are kept: the best sum under the rule that what lies in a dropped element is dropped.

    An element weighs the log of its own text, so that wrappers without text follow what is in them; unnamed
    inline elements are part of the text around them.
    """
    n = len(page.nodes)
    up = [x.parent for x in page.nodes]
    own = np.array([0.0 if x.hidden else float(x.own) for x in page.nodes])
    inline = [TAG_GROUP.get(x.tag) == "inline" and not x.hidden and _named(x)[0] == 0 for x in page.nodes]
    for k in range(n - 1, 0, -1):
        if inline[k]:
            own[up[k]] += own[k]
            own[k] = 0
    best = (np.log1p(own) + 0.05) * odds
    for k in range(n - 1, 0, -1):  # children are settled before their parents
        if inline[k]:
            best[k] -= 0.05 * odds[k]
            best[up[k]] += best[k]  # both ways: it has no say of its own
        elif page.nodes[k].hidden:
            best[k] = -np.inf
        elif best[k] > 0:
            best[up[k]] += best[k]
    keep = np.zeros(n, bool)
    keep[0] = True
    for k in range(1, n):
        keep[k] = keep[up[k]] and (inline[k] or best[k] > 0)
    return keep


def rendered(page: Page, keep: np.ndarray) -> str:
    """Text of the kept elements: blocks apart, character references decoded, white space as one space."""
    blocks, held = [], []
    for node, text in page.pieces:
        if text is None:
            if held:
                blocks.append("".join(held))
                held = []
        elif keep[node]:
            held.append(text)
    if held:
        blocks.append("".join(held))
    clean = (_SPACE.sub(" ", html.unescape(b) if "&" in b else b).strip() for b in blocks)
    return "\n".join([b for b in clean if b])


def extract(sources: list[str], forest: Forest | None) -> list[str]:
    """The main text of each page; the trees see all of their elements at once."""
    pages = [parse(source) for source in sources]
    rows = [features(page) for page in pages]
    if forest is None:
        odds = [np.where(plain_labels(p, r) == 0, -1.0, 1.0) for p, r in zip(pages, rows, strict=True)]
    else:
        every = forest.log_odds(np.vstack(rows)) if rows else np.zeros(0)
        odds = np.split(every, np.cumsum([len(r) for r in rows])[:-1])
    return [rendered(p, decode(p, o)) for p, o in zip(pages, odds, strict=True)]


def fit(pages: DataFrame) -> Forest | None:
    """The trees of a bounded sample's plainly named elements; None if they are not of both classes."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            out, named, weight = [], [], []
            for number, source in zip(part.column("number").to_pylist(), texts(part, "html"), strict=True):
                for page in map(parse, variants(source, number)):
                    rows = features(page)
                    labels = plain_labels(page, rows)
                    for k in np.flatnonzero(labels >= 0):
                        out.append(rows[k])
                        named.append(int(labels[k]))
                        weight.append(1.0 + float(np.log1p(page.nodes[k].own)))
            arrays = [pa.array(out, pa.list_(pa.float64())), pa.array(named, pa.int32()), pa.array(weight, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["features", "label", "weight"])

    # The ids are picked first, so that the task that merges the picks of all partitions sees no pages.
    usable = pages.where("html IS NOT NULL AND page_id IS NOT NULL").select("page_id", "html")
    picked = usable.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_PAGES)
    # At most TRAIN_PAGES ids are broadcast; of pages with the same id the least in order counts.
    sample = usable.join(F.broadcast(picked), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))
    sample = sample.select("html", F.pmod(F.xxhash64("page_id"), F.lit(VARIANTS)).alias("number"))
    merged = sample.mapInArrow(rows_of, "features array<double>, label int, weight double")
    # Alike elements are one row with their summed weight; order makes the trees the same each time.
    found = merged.groupBy("features", "label").agg(F.sum("weight").alias("weight")).orderBy("features", "label").collect()
    labels = np.array([r["label"] for r in found], float)
    if len(set(labels)) < 2:
        return None
    return boost(np.array([r["features"] for r in found]), labels, np.array([r["weight"] for r in found]))


def main_text(pages: DataFrame, forest: Forest | None) -> DataFrame:
    """page_id, url and the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            found = extract(texts(part, "html"), forest)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string")


@query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
