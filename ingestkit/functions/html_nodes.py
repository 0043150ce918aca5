"""One HTML page → one array of element nodes in document order.

A node's descendants are the contiguous run after it, up to ``last``; its text is the run
``[text_from, text_to)`` of the page's text pieces. With these two intervals every later step
(rows, cells, attributes, page variables) is a slice of an array inside one row: no node is ever
shuffled or joined. Only the page text crosses to Python.
"""

from __future__ import annotations

import re
import sys
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType([
    T.StructField("idx", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("nth", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("classes", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("above", T.ArrayType(T.IntegerType())),
    T.StructField("text_from", T.IntegerType()),
    T.StructField("text_to", T.IntegerType()),
])
PAGE = T.StructType([
    T.StructField("nodes", T.ArrayType(NODE)),
    T.StructField("texts", T.ArrayType(T.StringType())),
])

# Executors need no copy of this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the HTML standard: elements without content, and end tags that may be left out.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
_HEAD_ONLY = frozenset("title meta link base style script".split())
_FRAME = frozenset(("html", "head", "body"))
_P_SCOPE = ("table", "td", "th", "li", "button", "body")
_NOT_TEXT = frozenset(("script", "style"))


_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>
    |</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>
    |<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<broken>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>
    |(?P<text>[^<]+|<)""",
    re.DOTALL | re.VERBOSE,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class _Pages:
    """Tokenises page after page into one set of flat columns, ready to become Arrow arrays."""

    def __init__(self) -> None:
        self.idx: list[int] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.nth: list[int] = []
        self.tag: list[str] = []
        self.classes: list[str] = []
        self.text_from: list[int] = []
        self.text_to: list[int] = []
        self.keys: list[str] = []
        self.values: list[str] = []
        self.key_at = [0]
        self.above: list[int] = []
        self.above_at = [0]
        self.texts: list[str] = []
        self.node_at, self.text_at = [0], [0]

    def skip(self) -> None:
        self.node_at.append(len(self.idx))
        self.text_at.append(len(self.texts))

    def add(self, page: str) -> None:
        self._base, self._first_text = len(self.idx), len(self.texts)
        self._open: list[int] = []       # open elements of this page, outermost first ...
        self._tags: list[str] = []       # ... and their tags
        self._children: list[int] = []   # children seen so far, per node
        self._seen: set[str] = set()     # which of html, head and body exist
        self._scan(page)
        while self._open:
            self._pop()
        self.skip()

    def _push(self, tag: str) -> None:
        index = len(self.idx) - self._base
        parent, nth = -1, 1
        if self._open:
            parent = self._open[-1]
            nth = self._children[parent] = self._children[parent] + 1
        self.idx.append(index)
        self.parent.append(parent)
        self.last.append(index)
        self.nth.append(nth)
        self.tag.append(tag)
        self.classes.append("")
        self.key_at.append(len(self.keys))
        self.above.extend(self._open)
        self.above_at.append(len(self.above))
        place = len(self.texts) - self._first_text
        self.text_from.append(place)
        self.text_to.append(place)
        self._children.append(0)
        self._open.append(index)
        self._tags.append(tag)

    def _attributes(self, source: str) -> None:
        seen: set[str] = set()
        for name, double, single, bare in _ATTR.findall(source):
            name = name.lower()
            if name in seen:
                continue  # the first of equal names counts
            seen.add(name)
            value = double or single or bare
            if "&" in value:
                value = unescape(value)
            self.keys.append(name)
            self.values.append(value)
            if name == "class" and value:
                self.classes[-1] = f" {' '.join(value.split())} "
        self.key_at[-1] = len(self.keys)

    def _pop(self) -> None:
        place = self._base + self._open.pop()
        self._tags.pop()
        self.last[place] = len(self.idx) - self._base - 1
        self.text_to[place] = len(self.texts) - self._first_text

    def _close_through(self, tags, barrier) -> None:
        """Close the outermost open element among ``tags`` above the nearest barrier."""
        cut = None
        for position in range(len(self._tags) - 1, -1, -1):
            tag = self._tags[position]
            if tag in barrier:
                break
            if tag in tags:
                cut = position
        if cut is not None:
            while len(self._open) > cut:
                self._pop()

    def _frame(self, tag: str) -> bool:
        """Supply html, head and body where a page leaves them out; False for a repeated one."""
        if tag in _FRAME:
            if tag in self._seen:
                return False
            self._seen.add(tag)
            if tag == "html":
                return True
        if "html" not in self._seen:
            self._seen.add("html")
            self._push("html")
        if tag == "head":
            return True
        if tag == "body":
            self._close_through(("head",), ("html",))
        elif tag in _HEAD_ONLY:
            if "head" not in self._seen:
                self._seen.add("head")
                self._push("head")
        else:
            self._close_through(("head",), ("html",))
            self._seen.add("body")
            self._push("body")
        return True

    def _start(self, tag: str, source: str) -> None:
        if ("body" not in self._seen or tag in _FRAME) and not self._frame(tag):
            return
        if tag in _CLOSES_P and "p" in self._tags:
            self._close_through(("p",), _P_SCOPE)
        if tag in _IMPLIED_END:
            self._close_through(*_IMPLIED_END[tag])
        self._push(tag)
        if source:
            self._attributes(source)
        if tag in _VOID:
            self._pop()

    def _end(self, tag: str) -> None:
        # text after </body> still belongs to the page
        if tag in _VOID or tag == "html" or tag == "body" or tag not in self._tags:
            return
        while self._tags[-1] != tag:
            self._pop()
        self._pop()

    def _text(self, text: str) -> None:
        if "body" not in self._seen and not text.isspace() and self._tags[-1:] != ["title"]:
            self._frame("#text")
        if self._open:
            self.texts.append(unescape(text) if "&" in text else text)

    def _scan(self, page: str) -> None:
        position, size, match = 0, len(page), _TOKEN.match
        while position < size:
            m = match(page, position)
            if m is None:  # a tag the page never closes
                break
            position = m.end()
            kind = m.lastgroup
            if kind == "text":
                self._text(m[kind])
            elif kind == "end":
                self._end(m[kind].lower())
            elif kind is not None:
                tag = (m["start"] or m["broken"]).lower()
                self._start(tag, m[kind])
                if tag in _NOT_TEXT:
                    # up to its end tag the content is no markup, and it is no page text either
                    close = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, position)
                    position = close.start() if close else size


@F.arrow_udf(PAGE)
def _parse_html(pages: pa.Array) -> pa.Array:
    out, int32, text = _Pages(), pa.int32(), pa.string()
    bodies = pages.to_pylist()
    for body in bodies:
        out.skip() if body is None else out.add(body)
    nodes = pa.StructArray.from_arrays(
        [
            pa.array(out.idx, int32), pa.array(out.parent, int32), pa.array(out.last, int32), pa.array(out.nth, int32),
            pa.array(out.tag, text), pa.array(out.classes, text),
            pa.MapArray.from_arrays(pa.array(out.key_at, int32), pa.array(out.keys, text), pa.array(out.values, text)),
            pa.ListArray.from_arrays(pa.array(out.above_at, int32), pa.array(out.above, int32)),
            pa.array(out.text_from, int32), pa.array(out.text_to, int32),
        ],
        names=["idx", "parent", "last", "nth", "tag", "classes", "attrs", "above", "text_from", "text_to"],
    )
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(out.node_at, int32), nodes),
            pa.ListArray.from_arrays(pa.array(out.text_at, int32), pa.array(out.texts, text)),
        ],
        names=["nodes", "texts"],
        mask=pa.array([body is None for body in bodies], pa.bool_()),
    )


def parse_html(body: Column) -> Column:
    return _PARSE(body)


# Non-deterministic only to the optimizer: a filter on a value taken from the page would otherwise
# be pushed below the parse together with a second copy of it.
_PARSE = _parse_html.asNondeterministic()


def below(nodes: Column, node: Column) -> Column:
    """The node's descendants, a slice of the page's node array."""
    return F.slice(nodes, node["idx"] + 2, node["last"] - node["idx"])


def text_of(texts: Column, node: Column) -> Column:
    """All text inside the node, pieces joined as they stand."""
    return F.array_join(F.slice(texts, node["text_from"] + 1, node["text_to"] - node["text_from"]), "")
