"""HTML to text with layout: a tree builder with implied tags, visibility rules, and a block renderer.

Blocks are set apart by line breaks, paragraphs and the like by a blank line; list items carry marks and indentation;
cells of a table's column start at one place: a column is as wide as its widest line of up to ``WIDTH`` characters, and
a longer line stands alone, with the cells to its right going on below it.  Preformatted text keeps its white space.
Scripts, styles, templates, the head, and elements that are hidden by attribute or inline style are left out (what is
visible again within ``visibility: hidden`` isn't); all other text is kept.

Defined cases: null HTML gives a null text, empty HTML an empty one; pages are as long and elements nest as deep as they
do; unknown end tags are skipped; equal pages give equal texts; repeated rows stay; other columns, whatever their names,
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest line of a cell that takes part in the column's width.
WIDTH = 40
MAX_COLSPAN = 1000  # as in HTML
MAX_ROWSPAN = 65_534  # as in HTML; 0 stands for the rest of the row group
#: Element classes of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"head", "script", "style", "template", "title", "noembed", "noframes", "iframe", "datalist", "meta", "link", "object"}
#: Children of svg and math that are never shown.
UNDRAWN = {"defs", "symbol", "clippath", "mask", "marker", "pattern", "metadata", "desc", "annotation", "annotation-xml"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", "hr", "fieldset"}
BLOCK = SPACED | {"address", "article", "aside", "body", "caption", "center", "dd", "details", "dialog", "div", "dir", "dt", "figcaption", "footer", "form", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "option", "search", "section", "summary", "optgroup", "select", "tbody", "td", "textarea", "tfoot", "th", "thead", "tr", "xmp"}
HEAD = {"base", "link", "meta", "script", "style", "template", "title", "noscript"}
#: What a start tag closes, and the elements beyond which it closes nothing.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
WALLS = {"table", "td", "th", "caption", "button", "object", "html", "template"}
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>", re.S)  # quotes open a value after = only
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_BOX = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_WHITE = re.compile(r"[ \t\n\f\r]+")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    if "=" not in raw and "hidden" not in raw.lower():
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def build(page: str) -> Node:
    """The tree of a page, with tags that HTML implies opened and closed."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
    at, tags_end = 0, max(page.rfind(">"), page.rfind("<!")) + 1  # no tag ends later; a comment may be open

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(low: int) -> None:
        for x in stack[low:]:
            places[x.tag].pop()
        del stack[low:]

    def last(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and not raw.isspace():
                cut(len(stack) - 1)
            stack[-1].children.append(entities.unescape(raw) if "&" in raw else raw)

    def close(tags: set[str], walls: set[str]) -> None:
        low = last(tags)
        if low > last(walls):
            while low > 1 and stack[low - 1].tag in tags:
                low -= 1
            cut(low)

    while at < len(page):
        m = _TOKEN.search(page, at) if at < tags_end else None
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            low = last({tag})
            if low and (tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or low >= last(WALLS)):
                cut(low)
            continue
        attributes = _attributes(m[3])
        if tag == "html":
            root.attributes = attributes | root.attributes
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            cut(len(stack) - 1)
        if tag in CLOSES:
            close(*CLOSES[tag])
        elif tag in BLOCK and tag not in ("option", "select"):
            close({"p"}, WALLS)
        if tag in UNDRAWN and last({"svg", "math"}):
            attributes["hidden"] = ""
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            node.children.append(entities.unescape(inner) if tag == "textarea" else inner)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3].endswith("/") and (tag in ("svg", "math", "path", "use") or last({"svg", "math"}))):
            push(node)
    return root


def visible(node: Node) -> bool:
    """Whether the element has a box at all."""
    a = node.attributes
    return not (node.tag in UNSEEN or a and ("hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or ("style" in a and _NO_BOX.search(a["style"]))))


def shows(node: Node, before: bool) -> bool:
    """Whether the element's own text is shown, as its style has it or else as around it."""
    m = _VISIBILITY.findall(node.attributes["style"]) if "style" in node.attributes else None
    return m[-1].lower() == "visible" if m else before


class _Flow:
    """Lines of one block's content."""

    def __init__(self, keep: bool = False) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.keep = keep
        self.gap = False

    def flush(self) -> None:
        if not self.inline:
            return
        raw, self.inline = "".join(self.inline), []
        if self.keep:
            own = raw.split("\n")
        else:
            own = [_WHITE.sub(" ", part).strip(" ") for part in raw.split("\v")]
            while own and not own[-1]:
                own.pop()
            while own and not own[0]:
                own.pop(0)
        if own:
            self.add(own, False)

    def add(self, lines: list[str], spaced: bool) -> None:
        if not lines:
            return
        if self.lines and (spaced or self.gap) and self.lines[-1] != "":
            self.lines.append("")
        self.lines += lines
        self.gap = spaced


def _render(node: Node, keep: bool = False, shown: bool = True) -> list[str]:
    flow = _Flow(keep)
    _into(flow, node, keep, shown)
    flow.flush()
    return flow.lines


def _into(flow: _Flow, node: Node, keep: bool, shown: bool) -> None:
    shown = shows(node, shown)
    number = 0
    if node.tag == "ol":
        with_start = node.attributes.get("start", "1")
        number = int(with_start) - 1 if re.fullmatch(r"-?\d{1,9}", with_start) else 0
    for child in node.children:
        if isinstance(child, str):
            if shown:
                flow.inline.append(child if keep else child.replace("\v", " "))
        elif not visible(child):
            continue
        elif child.tag == "br":
            flow.inline.append("\n" if keep else "\v")
        elif child.tag == "hr":
            flow.flush()
            flow.gap = True
        elif child.tag in BLOCK:
            flow.flush()
            if child.tag == "table":
                lines = _table(child, shown)
            elif child.tag == "li":
                value = child.attributes.get("value", "")
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number + 1
                mark = f"{number}. " if node.tag == "ol" else "- "
                own = _render(child, keep, shown)
                lines = [(mark if i == 0 else " " * len(mark) if line else "") + line for i, line in enumerate(own)]
            elif child.tag in ("blockquote", "dd"):
                lines = [f"  {line}" if line else "" for line in _render(child, keep, shown)]
            else:
                lines = _render(child, keep or child.tag in ("pre", "textarea", "xmp"), shown)
                if child.tag in ("pre", "textarea", "xmp"):
                    lines = lines[1:] if lines and not lines[0].strip() else lines
                    while lines and not lines[-1].strip():
                        lines.pop()
            flow.add(lines, child.tag in SPACED and not (node.tag == "li" and child.tag in ("ul", "ol")))
        else:
            _into(flow, child, keep, shown)


def _row(cells: list[list[str]], widths: list[int]) -> list[str]:
    """A row's lines: every cell's lines start at its column's place."""
    columns: list[list[str]] = []
    alone: set[int] = set()  # lines that are too long for their column
    for cell, width in zip(cells, widths, strict=False):
        column: list[str] = []
        for line in cell:
            while len(column) in alone:
                column.append("")
            column.append(line)
        alone |= {k for k, line in enumerate(column) if len(line) > width}
        columns.append(column)
    return ["  ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(columns, widths, strict=False)).rstrip(" ") for k in range(max(map(len, columns), default=0))]


def _table(table: Node, shown: bool) -> list[str]:
    shown = shows(table, shown)
    rows: list[list[list[str]]] = []
    before: list[str] = []
    after: list[str] = []
    hang: dict[int, int] = {}  # rows for which a cell from above still takes a column
    todo = [(x, shown) for x in reversed(table.children)]
    while todo:
        x, lit = todo.pop()
        if x is None:
            hang.clear()
        elif isinstance(x, str):
            if x.strip() and lit:
                before.append(_WHITE.sub(" ", x).strip())
        elif not visible(x):
            continue
        elif x.tag in ("thead", "tbody", "tfoot"):
            hang.clear()
            todo += [(None, lit), *((y, shows(x, lit)) for y in reversed(x.children))]
        elif x.tag == "tr":
            own = shows(x, lit)
            cells: list[list[str]] = []
            new: dict[int, int] = {}
            for c in x.children:
                if isinstance(c, str):
                    if c.strip() and own:
                        cells.append([_WHITE.sub(" ", c).strip()])
                elif c.tag in ("td", "th") and not visible(c):
                    continue
                elif visible(c):
                    while len(cells) in hang:
                        cells.append([])
                    first = len(cells)
                    cells.append(_render(c if c.tag in ("td", "th") else Node("td", {}, [c]), shown=own))
                    span = c.attributes.get("colspan", "1")
                    cells += [[] for _ in range(min(int(span[:9]), MAX_COLSPAN) - 1 if span.isdecimal() and span.isascii() else 0)]
                    down = c.attributes.get("rowspan", "1")
                    down = min(int(down[:9]) or MAX_ROWSPAN, MAX_ROWSPAN) if down.isdecimal() and down.isascii() else 1
                    if down > 1:
                        new.update((i, down) for i in range(first, len(cells)))
            hang = {i: n - 1 for i, n in (hang | new).items() if n > 1}
            rows.append(cells)
        elif x.tag == "caption":
            before += _render(x, shown=lit)
        else:
            after += _render(Node("div", {}, [x]), shown=lit)
    widths: list[int] = []
    for cells in rows:
        for i, c in enumerate(cells):
            if i == len(widths):
                widths.append(0)
            widths[i] = max(widths[i], *(len(line) for line in c if len(line) <= WIDTH), 0)
    lines = [line for cells in rows for line in _row(cells, widths)]
    return [*before, *lines, *after]


def text_of(page: str | None) -> str | None:
    if page is None:
        return None
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1_000 + 4 * page.count("<")))  # calls of Python functions take no C stack
    try:
        return "\n".join(_render(build(page))).strip("\n")
    finally:
        sys.setrecursionlimit(limit)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """``key`` and ``text`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(text_of, batch.column(1).to_pylist()), pa.string())], names=["key", "text"])

    d = pages.select(F.col(key).alias("key"), F.col(page).cast("string").alias("page"))
    return d.mapInArrow(run, f"key {dict(pages.dtypes)[key]}, text string").withColumnRenamed("key", key)
