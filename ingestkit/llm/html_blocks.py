"""Main text of web pages: flat text blocks, judged by a small decision tree.

A page is cut into blocks at block-level tags; a block has text, words and the share of its words inside links. The
features of a block are its own word count and link density, those of the block before and after it, whether it is a
heading, and its zone: -1 inside an element that says it is no article (navigation, aside, footer, form, or a class, id
or role such as ``ad``, ``comments``, ``cookie``), 1 inside one that says it is (``article``, ``main``, ``post`` …), -0.5
below a word that may say either (``top``, ``social``, ``legal`` …), else 0. An ``article`` or ``main`` is article text
whatever such a weak word stands on it or above it.

The tree is grown (Gini impurity, whole numbers of samples per leaf) from ``SAMPLES``, a few pages in which the blocks
to keep carry the attribute ``data-keep``. Adding a page there is how the extractor is taught.

Cases: null or empty html and pages without text give an empty string; character references are decoded once, unknown
ones stay; white space in a block becomes one space; scripts, styles, comments, templates and the head have no text;
unclosed and stray tags are tolerated; repeated pages are extracted one by one; extra columns are left alone; nothing
is cut from long pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestkit.llm.common import fields

# fixed values: element names of HTML by role
_BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table
tbody td tfoot th thead tr ul""".split())
_RAW = frozenset("head iframe noembed noframes noscript object script select style svg template textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OUTSIDE = frozenset("aside button dialog footer form menu nav search".split())
_INSIDE = frozenset("article main".split())
_OUTSIDE_WORDS = frozenset("""ad ads adv advert advertisement adverts breadcrumb breadcrumbs comment commentlist comments consent
contentinfo cookie cookies disqus donate footer form gdpr login masthead menu modal nav navbar navigation newsletter notification pager
pagination popup privacy promo promoted promotion recommended related replies reply respond sidebar sidenav signup skip sponsor sponsored
subscribe subscription teaser toc toolbar tracking widget widgets
""".split())
_WEAK_WORDS = frozenset("""alert banner bar byline copyright discussion header legal links meta notice notices search share sharing shop social tag tags
top
""".split())
_INSIDE_WORDS = frozenset("article content entry main maincontent post story text body".split())
_LAYOUT_WORDS = frozenset("col columns container grid has inner layout no outer page row site with without wrap wrapper".split())

#: A comment, a tag, a tag with unbalanced quotes, a declaration. No part is tried again once matched, so time stays linear.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)((?>[a-zA-Z][^\s/><]*))((?>(?:"[^"<]*"|'[^'<]*'|[^<>"'])*))>|<(/?)((?>[a-zA-Z][^\s/>]*))((?>[^>]*))>|<[!?](?>[^>]*)>""", re.S)
_HINTS = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    zone: float
    heading: bool
    keep: bool


def _zone(name: str, attributes: str, zone: float) -> float:
    """Zone inside an element. Out of -1 nothing leads back in, out of -0.5 an article does; a layout class says nothing."""
    if zone == -1:
        return zone
    if name in _OUTSIDE:
        return -1
    outside = inside = weak = partly = False
    if attributes and name not in ("html", "body"):
        for found in _HINTS.findall(attributes):
            for value in " ".join(found).split():
                pieces = {p.lower() for p in _PARTS.findall(value)}
                if pieces & _LAYOUT_WORDS:
                    continue
                outside |= bool(pieces & _OUTSIDE_WORDS)
                weak |= bool(pieces & _WEAK_WORDS) and not (zone > 0 and pieces & {"header", "top"})
                inside |= bool(pieces) and pieces <= _INSIDE_WORDS  # a whole class: post, not post-meta
                partly |= bool(pieces & _INSIDE_WORDS)
    if outside and not (name in _INSIDE and partly):  # an article that says so is one, whatever its state
        return -1
    if name in _INSIDE or (inside and zone >= 0):
        return 1
    if weak or (name == "header" and zone == 0 and not partly):
        return -0.5 if weak else -1
    return 1 if partly and zone >= 0 else zone


def blocks(page: str | None) -> list[Block]:
    """Blocks with text, in page order."""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, float, bool]] = []  # open block elements: name, zone, data-keep
    zone, keep, heading, in_link = 0, False, False, False

    def close() -> None:
        words = entities.unescape("".join(text)).split()
        if words:
            inside = len(entities.unescape("".join(linked)).split())
            out.append(Block(" ".join(words), len(words), min(inside, len(words)), zone, heading, keep))
        text.clear()
        linked.clear()

    def add(piece: str) -> None:
        text.append(piece)
        if in_link:
            linked.append(piece)

    page = page or ""
    at, last, unclosed = 0, page.rfind(">"), set()
    while at < len(page):
        begin = page.find("<", at)
        m = None
        while 0 <= begin and (begin <= last or page.startswith("<!--", begin)):
            m = _TAG.match(page, begin)
            if m:
                break
            begin = page.find("<", begin + 1)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing, attributes = bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
        if name in _RAW:
            if not closing and not attributes.endswith("/") and name not in unclosed:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in ("head", "noscript", "object", "select"):
                    unclosed.add(name)
                else:
                    at = len(page)
            if name in _BLOCKS:
                close()
        elif name == "br":
            add(" ")
        elif name == "a":
            in_link = not closing
            if closing:
                linked.append(" ")
        elif name in _BLOCKS:
            close()
            in_link = False
            heading = name in _HEADINGS and not closing
            if name in _VOID:
                continue
            if closing:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if depth is not None:
                    del stack[depth:]
            else:
                if name == "p" or name in _HEADINGS:  # neither holds another of its kind
                    while stack and stack[-1][0] in ("p", *_HEADINGS):
                        stack.pop()
                elif stack and stack[-1][0] == "p":
                    stack.pop()
                above = stack[-1][1] if stack else 0
                stack.append((name, _zone(name, attributes, above), "data-keep" in attributes or bool(stack and stack[-1][2])))
            zone, keep = (stack[-1][1], stack[-1][2]) if stack else (0, False)
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    """Words and link density of the block, the one before and the one after; heading; zone."""
    own = np.array([(b.words, b.linked / b.words, b.heading, b.zone) for b in found], float).reshape(-1, 4)
    edge = np.zeros((1, 2))
    return np.hstack((own[:, :2], np.vstack((edge, own[:-1, :2])), np.vstack((own[1:, :2], edge)), own[:, 2:]))[:len(found)]


@dataclass
class Tree:
    """A leaf has only ``keep``; a node sends rows with ``x[column] <= cut`` to ``low``."""
    keep: bool
    column: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def judge(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.keep)
        below = x[:, self.column] <= self.cut
        return np.where(below, self.low.judge(x), self.high.judge(x))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Tree:
    """The split of least Gini impurity at midpoints between values; among equal splits the one named by more telling
    columns: zone first, then the block's own, then its neighbours'."""
    leaf = Tree(bool(y.mean() >= 0.5) if len(y) else False)
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return leaf
    best = (2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for column in (7, 0, 1, 2, 3, 4, 5, 6):
        values = np.unique(x[:, column])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, column] <= cut
            n = int(low.sum())
            if min(n, len(y) - n) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            impurity = (n * 2 * a * (1 - a) + (len(y) - n) * 2 * b * (1 - b)) / len(y)
            if impurity < best[0] - 1e-12:
                best = (impurity, column, float(cut))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(leaf.keep, best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


_LONG = "The river rose slowly through the night, and by the morning the lower fields were under water as far as anyone could see."
_MIDDLE = "Nobody had expected that the old bridge would hold."
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "sports", "weather"))

#: The labelled table: blocks below an element with data-keep are article text, all others are not.
SAMPLES = (
    f"<body><nav><ul>{_LINKS}</ul></nav><article data-keep><h1>Flood</h1><p>{_LONG}</p><p>{_MIDDLE}</p><p>Yes.</p></article><footer>All rights reserved.</footer></body>",
    f'<body><header><h2>The Daily</h2><ul>{_LINKS}</ul></header><div class="ad">Buy cheap boats now, only today.</div><main data-keep><h1>Rain</h1><p>{_LONG}</p></main></body>',
    f"<body><div><ul>{_LINKS}</ul></div><h1 data-keep>A short title</h1><p data-keep>{_LONG} {_LONG}</p><p data-keep>{_LONG}</p><p data-keep>{_MIDDLE}</p><p data-keep>{_LONG}</p><div>Copyright notice</div></body>",
    f'<body><div id="cookie-notice"><p>{_MIDDLE} We use cookies. {_LONG}</p></div><div class="post" data-keep><h2>Boats</h2><p>{_MIDDLE}</p><ul><li>rope</li><li>oars</li></ul></div><section id="comments"><p>{_LONG}</p></section></body>',
    f'<body><aside><p>{_LONG}</p></aside><article data-keep><p><a href="/x">See the river from the tower</a></p><p>{_MIDDLE} <a href="/y">map</a></p></article><form><p>Your name</p></form></body>',
    f'<body><header><p>{_LONG}</p></header><article data-keep><p>{_LONG}</p></article><div class="comments"><p>{_LONG}</p><p>{_MIDDLE}</p><p>{_LONG} {_LONG}</p></div></body>',
    f'<body><div class="sidebar"><h3>About</h3><p>{_LONG}</p><p>{_LONG} {_MIDDLE}</p></div><div data-keep><p>{_LONG}</p><p>{_LONG}</p></div><footer><p>{_LONG}</p><p>{_MIDDLE}</p></footer></body>',
    f'<body><p data-keep>{_LONG}</p><div class="ad"><p>{_MIDDLE}</p><p>{_LONG}</p></div><p data-keep>{_LONG}</p><div class="related"><p>{_LONG} {_LONG}</p></div><p data-keep>{_MIDDLE} {_LONG}</p></body>',
    f'<body><nav><p>{_MIDDLE}</p><p>{_LONG}</p></nav><h1 data-keep>A title</h1><p data-keep>{_LONG}</p><form><p>{_LONG}</p><p>{_MIDDLE} {_MIDDLE}</p></form></body>',
    f"<body><p>Home</p><p>News</p><p data-keep>{_LONG}</p><p data-keep>{_LONG} {_MIDDLE}</p><p><a href='/a'>Next story about boats and other things to read today</a></p><p><a href='/b'>More</a></p></body>",
    f'<body><div id="top"><p>{_MIDDLE}</p><article data-keep><p>{_LONG}</p></article></div><div class="legal"><p>{_LONG} {_LONG}</p><p>{_LONG}</p></div></body>',
    f'<body><article data-keep><p>{_LONG}</p></article><div class="social share"><p>{_LONG}</p><p>{_MIDDLE}</p><p>{_LONG}</p></div></body>',
    f"<body><div>Menu</div><div><a href='/q'>Log in</a></div><div data-keep>{_LONG} {_MIDDLE}</div><div>Contact</div></body>",
)


def learned(samples: tuple[str, ...] = SAMPLES) -> Tree:
    pages = [blocks(s) for s in samples]
    return grow(np.vstack([features(p) for p in pages]), np.array([b.keep for p in pages for b in p]))


def main_text(tree: Tree, page: str | None) -> str:
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, tree.judge(features(found))) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    tree = learned()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(tree, cell.as_py()) for cell in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    named = fields(pages, page_id=id_col, url=url_col, html=html_col)
    kind = named.schema["page_id"].dataType.simpleString()
    return named.mapInArrow(step, f"page_id {kind}, url string, text string, n_chars bigint")
