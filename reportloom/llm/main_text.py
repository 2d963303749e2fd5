"""Main text of web pages by minimum cut.

A page is read into blocks: runs of text between the borders of block elements. A classifier gives each block a
probability of being content; its two costs, -log p and -log(1 - p), are the capacities of the block's edges to
the two terminals. Blocks next to each other and blocks of one parent are joined by smoothness edges, the weaker
the further apart they are in the element tree. The minimum cut, found by max-flow, separates content from
boilerplate with the least sum of costs. Blocks whose own evidence outweighs all their edges are settled first,
which does not change the cut and leaves small graphs.

The classifier is a logistic function of a block's form (length, links, punctuation, element, depth, place),
trained on a bounded sample of pages whose blocks are weakly labelled by the elements around them, plus the
evidence of those elements and of telling words in class, id and role. The weights of that evidence are learned on
top of the form and bounded, so that form and edges together can outvote it. An outer element that holds most of a
page's prose is its wrapper and counts for nothing, and the page's chief article or main element lifts what lies
above it.
"""

from __future__ import annotations

import math
import re
from collections import deque
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, map_texts, sample_of, sample_order

#: Pages that the classifier is trained on at most (and ``common.SAMPLE_CHARS`` characters of them).
SAMPLE_PAGES = 400
#: Elements of HTML by role, and telling words in class, id and role attributes.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("head script style noscript template annotation annotation-xml desc metadata iframe select textarea button datalist title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTER_TAGS = frozenset("nav footer aside form menu dialog".split())
OUTER_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " subscribe subscription newsletter signup login share sharing social related recommended sidebar sidenav aside widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer"
    " masthead topbar toolbar copyright disclaimer comment comments commentlist reply replies respond disqus discussion contentinfo complementary search form dialog skip".split()
)
HEAD_WORDS = frozenset("header head".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
WORD = re.compile(r"[A-Za-z][a-z]*|\d+")
#: Smoothness weights, and the most (in log-odds) that a block's form and the elements around it can say.
NEXT_WEIGHT, PARENT_WEIGHT, MOST_FORM, MOST_EVIDENCE = 1.0, 2.0, 4.0, 6.0
#: What is left of an edge's weight where one block is within an outer element and the other is not.
CONTRAST = 0.5
#: Evidence before learning: outer tag, outer word, main tag, main word.
FIRST_EVIDENCE = np.array([-5.0, -5.0, 5.0, 5.0])


@dataclass
class Block:
    text: str
    tag: str
    parent: int
    depth: int
    links: float
    element: int
    path: tuple[int, ...] = field(default=())
    signs: tuple[bool, bool, bool, bool] = (False, False, False, False)  # outer tag, outer word, main tag, main word

    @property
    def outer(self) -> bool:
        return self.signs[0] or self.signs[1]

    @property
    def main(self) -> bool:
        return self.signs[2] or self.signs[3]


@dataclass
class Element:
    parent: int
    signs: tuple[bool, bool, bool, bool]


class BlockReader(HTMLParser):
    """Blocks of a page in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, number, hidden, inside article or main
        self.elements = [Element(0, (False, False, False, False))]
        self.buffer, self.linked, self.in_link = [], 0, 0

    def flush(self) -> None:
        raw = "".join(self.buffer)
        text = " ".join(raw.split())
        if text:
            above = [s for s in self.stack if s[0] in BLOCK_TAGS]
            tag = above[-1][0] if above else ""
            element = self.stack[-1][1] if self.stack else 0
            self.blocks.append(Block(text, tag, above[-2][1] if len(above) > 1 else 0, len(above), min(1.0, self.linked / max(1, len(raw))), element, tuple(s[1] for s in above)))
        self.buffer, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.buffer.append(" ")
        if tag in BLOCK_TAGS:
            self.flush()
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
            borders = ("ul", "ol", "menu", "dir", "dl", "table")
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in closes or self.stack[i][0] == "p":
                    del self.stack[i:]
                    break
                if self.stack[i][0] in borders or (self.stack[i][0] in BLOCK_TAGS and not closes):
                    break
        if tag in VOID_TAGS:
            return
        parent, hidden, inside = self.stack[-1][1:] if self.stack else (0, False, False)
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "style", "hidden", "aria-hidden")}
        words = {w.lower() for k in ("class", "id", "role") for w in WORD.findall(named.get(k, ""))} | {w.lower() for k in ("class", "id") for w in named.get(k, "").split()}
        hidden = hidden or tag in HIDDEN_TAGS or "hidden" in named or "display:none" in named.get("style", "").replace(" ", "").lower()
        inside = inside or tag in ("article", "main")
        signs = (False, False, False, False)
        if tag not in ("html", "body"):
            signs = (tag in OUTER_TAGS or (tag == "header" and not inside), bool(words & OUTER_WORDS) or (bool(words & HEAD_WORDS) and not inside), tag in ("article", "main"), bool(words & MAIN_WORDS))
        self.elements.append(Element(parent, signs))
        self.stack.append((tag, len(self.elements) - 1, hidden, inside))
        self.in_link += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
            if self.stack[i][0] in BLOCK_TAGS and tag not in BLOCK_TAGS:
                break
        self.in_link = sum(s[0] == "a" for s in self.stack) if self.in_link else 0

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][2]:
            return
        self.buffer.append(data)
        if self.in_link:
            self.linked += len(data)


def read_blocks(html: str) -> list[Block]:
    """The blocks of a page; markup that the parser refuses counts as text from there on."""
    reader = BlockReader()
    try:
        reader.feed(html)
        reader.close()
    except AssertionError:
        reader.handle_data(reader.rawdata)
    reader.flush()
    return signed(reader.blocks, reader.elements)


def signed(blocks: list[Block], elements: list[Element]) -> list[Block]:
    """The blocks with the evidence of the elements around them.

    An outer element that holds more than half of the page's prose (text outside links) is a wrapper and counts for
    nothing, unless main elements outside it hold a tenth of its prose. An article or main element that holds half
    of the prose of all main elements is the chief one, unless main elements outside it and outside any outer one
    hold a tenth of its prose: outer elements above it count for nothing within it, nor do its own words if it holds
    a quarter of the page's prose. Main elements within other outer elements are outer.
    """
    near, within = [False] * len(elements), [False] * len(elements)  # nearest evidence is main; within an outer element
    for i, e in enumerate(elements[1:], 1):
        outer = e.signs[0] or e.signs[1]
        near[i] = not outer if any(e.signs) else near[e.parent]
        within[i] = outer or within[e.parent]
    prose, named, free = ([0.0] * len(elements) for _ in range(3))
    for b in blocks:
        size = len(b.text) * (1 - b.links)
        prose[b.element] += size
        named[b.element] += size if near[b.element] else 0.0
        free[b.element] += size if near[b.element] and not within[b.element] else 0.0
    for i in range(len(elements) - 1, 0, -1):
        prose[elements[i].parent] += prose[i]
        named[elements[i].parent] += named[i]
        free[elements[i].parent] += free[i]
    found = [(False, False, False, False)] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        a, b, c, d = found[e.parent]
        p, q = e.signs[:2]
        if (p or q) and 2 * prose[i] > prose[0] and 10 * (named[0] - named[i]) < prose[i]:
            p = q = False
        if e.signs[2] and 10 * (free[0] - free[i]) < prose[i] and 2 * prose[i] >= named[0] and (not q or 4 * prose[i] >= prose[0]):
            a = b = q = False
        found[i] = (a or p, b or q, c or e.signs[2], d or e.signs[3])
    for b in blocks:
        signs = found[b.element]
        b.signs = (*signs[:2], False, False) if signs[0] or signs[1] else signs
    return blocks


def form_of(blocks: list[Block]) -> np.ndarray:
    """What the classifier sees of each block: its form alone."""
    n = max(1, len(blocks) - 1)
    rows = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        marks = sum(map(b.text.count, ".,;:!?"))
        rows.append((math.log1p(words), b.links, min(1.0, marks / words), float(b.tag in ("p", "pre", "blockquote")), float(b.tag in HEADINGS), float(b.tag == "li"), min(b.depth, 12) / 12, abs(2 * i / n - 1) if len(blocks) > 1 else 0.5))
    return np.array(rows).reshape(len(blocks), 8)


def fit_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    """Weights of form and a constant, then of the four kinds of evidence, from SAMPLE_PAGES pages at most in a
    fixed pseudo-random order.

    Blocks within main elements and outside any outer one count as content, blocks within outer elements as
    boilerplate, others not at all. The form is fitted alone, on each block with and without its tag, so that pages of
    plain divisions have costs by words, links and marks; then the evidence on top of it; as the labels come from
    that evidence, a kind of evidence that the sample shows gets a weight near its bound, one that it lacks keeps
    ``FIRST_EVIDENCE``. Without both classes, the form says nothing.
    """
    some = pages.where(F.col(id_col).isNotNull()).select(id_col, sample_order(id_col).alias("__order")).orderBy("__order", id_col).limit(SAMPLE_PAGES)
    forms, signs, labels = [], [], []
    for r in sample_of(pages, some.select(id_col).distinct(), id_col, html_col, []):
        blocks = read_blocks(r["__text"])
        form = form_of(blocks)
        for b, f in zip(blocks, form, strict=True):
            if b.outer or b.main:
                forms.append(f)
                signs.append(b.signs)
                labels.append(0 if b.outer else 1)
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return np.concatenate([np.zeros(9), FIRST_EVIDENCE])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    blind = np.array(forms)
    blind[:, 3:6] = 0.0
    form = fit_logistic(np.vstack([forms, blind]), np.tile(y, 2), np.tile(weight, 2) / 2, ridge=1.0)
    signs = np.array(signs, float)
    known = form_odds(np.array(forms), form) + signs @ FIRST_EVIDENCE
    learned = FIRST_EVIDENCE + fit_logistic(signs, y, weight, ridge=1.0, known=known)
    return np.concatenate([form, np.clip(learned, [-MOST_EVIDENCE, -MOST_EVIDENCE, 0, 0], [0, 0, MOST_EVIDENCE, MOST_EVIDENCE])])


def form_odds(forms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(forms @ weights[:8] + weights[8], -MOST_FORM, MOST_FORM)


def settle(odds: list[float], edges: dict[int, dict[int, float]]) -> list[bool]:
    """The minimum cut of binary labels: odds are log-odds of True, ``edges`` the price of unequal labels."""
    odds, label = list(odds), [None] * len(odds)
    room = {i: sum(edges[i].values()) for i in range(len(odds))}
    queue = deque(range(len(odds)))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(odds[i]) >= room[i]:
            label[i] = odds[i] > 0
            for j, w in edges[i].items():
                if label[j] is None:
                    odds[j] += w if label[i] else -w
                    room[j] -= w
                    queue.append(j)
    left = [i for i, v in enumerate(label) if v is None]
    if left:
        for i in reachable(left, odds, edges):
            label[i] = True
    return [bool(v) for v in label]


def reachable(nodes: list[int], odds: list[float], edges: dict[int, dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut, by shortest augmenting paths."""
    inside = set(nodes)
    flow = {i: {j: w for j, w in edges[i].items() if j in inside} for i in nodes}
    flow[-1] = {i: odds[i] for i in nodes if odds[i] > 0}
    for i in nodes:
        flow[i][-2] = max(0.0, -odds[i])
    flow[-2] = {}
    while True:
        came, queue = {-1: -1}, deque([-1])
        while queue and -2 not in came:
            i = queue.popleft()
            for j, w in flow[i].items():
                if w > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if -2 not in came:
            return set(came) - {-1}
        path, j = [], -2
        while j != -1:
            path.append((came[j], j))
            j = came[j]
        most = min(flow[i][j] for i, j in path)
        for i, j in path:
            flow[i][j] -= most
            flow[j][i] = flow[j].get(i, 0.0) + most


def extract(html: str, weights: np.ndarray) -> str:
    """The main text of a page: content blocks in page order, joined by newlines."""
    blocks = read_blocks(html)
    if not blocks:
        return ""
    evidence = np.clip(np.array([b.signs for b in blocks], float) @ weights[9:], -MOST_EVIDENCE, MOST_EVIDENCE)
    odds = (form_odds(form_of(blocks), weights) + evidence).tolist()
    edges: dict[int, dict[int, float]] = {i: {} for i in range(len(blocks))}

    def join(i: int, j: int, w: float) -> None:
        w *= 1.0 if blocks[i].outer == blocks[j].outer else CONTRAST
        edges[i][j] = edges[i].get(j, 0.0) + w
        edges[j][i] = edges[j].get(i, 0.0) + w

    last_of: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            shared = sum(x == y for x, y in zip(a.path, b.path, strict=False))
            join(i - 1, i, NEXT_WEIGHT / (1 + len(a.path) + len(b.path) - 2 * shared))
        if b.parent in last_of:
            join(last_of[b.parent], i, PARENT_WEIGHT)
        last_of[b.parent] = i
    return "\n".join(b.text for b, content in zip(blocks, settle(odds, edges), strict=True) if content)


def extract_pages(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns id_col, url_col, text, n_chars (code points), a row for each row of ``pages``.

    Null and empty html give empty text. Character references are decoded, white space within a block becomes one
    space, blocks are trimmed and joined by one newline. Pages are read whole. Extra columns are ignored; rows with
    null or repeated ids keep a row each; an empty table gives an empty result.
    """

    def make():
        def call(texts):
            found = [extract(t, weights) for t in texts]
            return [found, list(map(len, found))]

        return call

    return map_texts(pages, html_col, "text string, n_chars long", make, [id_col, url_col])
