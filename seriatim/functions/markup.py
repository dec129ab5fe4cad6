"""A page's tree, built as HTML has it for pages as they come: implied heads, bodies, paragraphs, items, rows and cells.

One pass over tags: what stands before the first thing that belongs in a body is the head's, whether or not it is
closed; start tags end the paragraph, item, cell or row that they can't stand in; an end tag closes what it names unless
something heavier is open in between (a stray one closes nothing); a table's rows get their body, its cells their row.
Content that can't stand in a table stays where it is.  A comment or tag that the page's end cuts off takes the rest of
the page with it.  The time grows with the page, however malformed.

``main_part`` finds the main content by density: a block of text lends its weight to its parent and half of it to its
grandparent, links count against it, and the block that gathers most is the main content.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

#: Element classes of HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HEADED = set("base link meta script style template title noscript".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | set("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split())
CELLS, ROWS = {"td", "th"}, {"thead", "tbody", "tfoot"}
TABLE = CELLS | ROWS | {"tr", "caption", "colgroup"}
WALLS = {"table", "td", "th", "caption", "button", "object", "template"}
SPECIAL = BLOCKS | WALLS
#: What may stand between an item and the next one's start, and is closed with it.
LIGHT = {"address", "div", "p"}
#: What a start tag closes, up to the nearest of the others.
CLOSED = {
    "li": ({"li"}, SPECIAL - LIGHT - {"li"}),
    "dt": ({"dt", "dd"}, SPECIAL - LIGHT - {"dt", "dd"}),
    "dd": ({"dt", "dd"}, SPECIAL - LIGHT - {"dt", "dd"}),
    "option": ({"option"}, {"select"}),
    "td": (CELLS | {"caption", "colgroup"}, {"tr", "table"}),
    "th": (CELLS | {"caption", "colgroup"}, {"tr", "table"}),
    "tr": (CELLS | {"tr", "caption", "colgroup"}, {"table"}),
} | {t: (TABLE, {"table"}) for t in (*ROWS, "caption", "colgroup")}
#: An end tag closes no open element that is heavier than its own.
WEIGHT = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5}
_TAG = re.compile(r"<(?:!--(?:>|->|(?s:.*?)(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(>|\Z))")
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def walk(self) -> Iterator[Node | str]:
        """The node and all below it, in the page's order."""
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Node):
                todo += reversed(x.children)

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def whole(page: str) -> str:
    """The page up to a comment or tag that its end cuts off."""
    for m in _TAG.finditer(page):
        if m.end() == len(page) and not m[0].endswith(">"):
            return page[: m.start()]
    return page


class _Builder:
    def __init__(self) -> None:
        self.head, self.body = Node("head"), Node("body")
        self.stack, self.places, self.in_head = [self.body], {}, True
        self.unended: set[str] = set()  # raw elements without a further end tag

    def push(self, tag: str, own: dict[str, str] | None = None) -> None:
        node = Node(tag, own)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def cut(self, low: int) -> None:
        """Closes all from place ``low`` of the stack on."""
        for x in self.stack[low:]:
            self.places[x.tag].pop()
        del self.stack[low:]

    def last(self, tags: set[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tags: set[str], walls: set[str]) -> None:
        wall = self.last(walls)
        low = min((p[i] for t in tags if (p := self.places.get(t)) and (i := bisect_right(p, wall)) < len(p)), default=0)
        if low:
            self.cut(low)

    def text(self, raw: str) -> None:
        if raw and not (self.in_head and raw.isspace()):
            self.in_head = False
            self.stack[-1].children.append(unescape(raw) if "&" in raw else raw)

    def start(self, tag: str, own: dict[str, str]) -> None:
        if tag in CLOSED:
            if tag in TABLE and not self.places.get("table"):
                return
            self.close(*CLOSED[tag])
        if tag in BLOCKS:
            self.close({"p"}, WALLS)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.cut(len(self.stack) - 1)
        if tag == "a" and self.last({"a"}) > self.last(SPECIAL):
            self.cut(self.last({"a"}))
        if tag in CELLS | {"tr"} and self.stack[-1].tag == "table":
            self.push("tbody")
        if tag in CELLS and self.stack[-1].tag in ROWS:
            self.push("tr")
        self.push(tag, own)

    def end(self, tag: str) -> None:
        low = self.last({tag})
        if low and not any(self.last({t}) > low for t, w in WEIGHT.items() if w > WEIGHT.get(tag, 0)):
            self.cut(low)


def parse(page: str) -> tuple[Node, Node]:
    """The head and the body of a page."""
    b, at = _Builder(), 0
    while at < len(page):
        m = _TAG.search(page, at)
        b.text(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag or not m[4] or tag in ("html", "head"):
            continue
        if tag == "body":
            b.in_head = False
        elif m[1]:
            b.end(tag)
        elif tag in RAW or (b.in_head and tag in ("noscript", "template")):
            end = None if tag in b.unended else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if not end:
                b.unended.add(tag)
            if end or tag in RAW:
                node = Node(tag, attributes(m[3]))
                inner = page[at : end.start() if end else len(page)]
                node.children.append(unescape(inner) if tag in ("title", "textarea") else inner)
                (b.head if b.in_head and tag in HEADED else b.stack[-1]).children.append(node)
                b.in_head &= tag in HEADED
                at = end.start() if end else len(page)
        elif b.in_head and tag in HEADED:
            b.head.children.append(Node(tag, attributes(m[3])))
        else:
            b.in_head = False
            b.start(tag, attributes(m[3]))
    return b.head, b.body


#: Fixed values of the density rule: least letters of a block that counts, letters a point, most points for length, and
#: elements that never hold main content.
LEAST, A_POINT, MOST = 25, 100, 3
ASIDE = set("script style nav iframe form button select textarea noscript header footer aside svg canvas template head title".split())
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd"}


def main_part(body: Node) -> Node:
    """The block that gathers most weight of text; the body if none gathers any.

    A paragraph (or what stands loose in any other element) of ``LEAST`` letters or more weighs 1, 1 for each comma, and 1
    for each ``A_POINT`` letters up to ``MOST``.  Its parent gets that, its grandparent half.  An element's sum counts for
    the share of its letters that isn't in links; of equals the first in the page's order wins.
    """
    order: list[tuple[Node, int]] = []  # with the parent's place
    todo, letters, linked, weight = [(body, -1, False)], [], [], []
    own: list[list[str]] = []
    while todo:
        node, parent, in_link = todo.pop()
        in_link |= node.tag == "a"
        spot = len(order)
        order.append((node, parent))
        texts = [x for x in node.children if isinstance(x, str)]
        n = len("".join(texts).strip())
        letters.append(n)
        linked.append(n if in_link else 0)
        weight.append(0.0)
        own.append(texts)
        todo += [(x, spot, in_link) for x in reversed(node.children) if isinstance(x, Node) and x.tag not in ASIDE]
    inline: list[str] = ["".join(t) for t in own]
    for i in range(len(order) - 1, 0, -1):  # letters and links of all below, and the text of inline elements with the block's
        node, parent = order[i]
        letters[parent] += letters[i]
        linked[parent] += linked[i]
        if node.tag not in BLOCKS and node.tag not in TABLE:
            inline[parent] += inline[i]
    for i, (node, parent) in enumerate(order):
        block = node.tag in BLOCKS or node.tag in TABLE or parent < 0
        t = inline[i].strip()
        if not block or len(t) < LEAST:
            continue
        points = 1 + t.count(",") + min(len(t) // A_POINT, MOST)
        up = parent if node.tag in PARAGRAPHS and parent >= 0 else i
        weight[up] += points
        if order[up][1] >= 0:
            weight[order[up][1]] += points / 2
    best = max(range(len(order)), key=lambda i: (weight[i] * (1 - linked[i] / max(1, letters[i])), -i))
    return order[best][0] if weight[best] * (1 - linked[best] / max(1, letters[best])) > 0 else body


def shown(part: Node) -> str:
    """A part's text by block: a line each, white space in it as one blank."""
    lines, run = [], []

    def flush() -> None:
        if t := " ".join("".join(run).split()):
            lines.append(t)
        run.clear()

    todo: list = [part]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag not in ASIDE:
            block = x.tag in BLOCKS or x.tag in TABLE or x.tag == "br"
            if block:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return "\n".join(lines)
