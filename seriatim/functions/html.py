"""HTML: cleaning for e-mail, and the facts of a page that the sources need.

``clean`` takes the body of a page's tree (``markup``), keeps an allow-list of elements and attributes and leaves out the
rest's tags, but not their text; elements that never belong in a letter go with all they hold.  Links and pictures keep
their address only with an allowed scheme.  Style sheets are among what goes, so no rules are left to inline: classes
go, and inline styles, for which there is no sanitiser, are emptied.

``facts`` gives titles, headings, links, metas, times, paragraphs and main content as one struct, in one pass of the
standard parser, so that all else is column expressions.  Its main content is the first article, else main, else a
division of class or id content, else the body.  ``main_text`` finds it by the density of text instead, for pages
without such marks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from seriatim.functions import markup
from seriatim.functions import text as T
from seriatim.functions.markup import Node

#: Elements and attributes that letters may have, and elements that go with their content.
ALLOWED = set("a abbr acronym b blockquote br code dd del div dl dt em h1 h2 h3 h4 h5 h6 hr i img li ol p pre q s span strong sub sup table tbody td tfoot th thead tr u ul figure figcaption cite mark small".split())
ATTRIBUTES = {"*": {"id", "style"}, "a": {"href", "title", "target", "rel"}, "img": {"src", "alt", "width", "height", "title"}, "td": {"colspan", "rowspan", "align", "valign"}, "th": {"colspan", "rowspan", "align", "valign"}, "ol": {"start", "type"}, "blockquote": {"cite"}}
DROPPED = set("script style nav iframe form input button select textarea noscript header footer aside svg canvas video audio object embed".split())
#: Schemes that links and pictures may have, and the attributes that are links.
SCHEMES = {"http", "https", "mailto"}
LINKS = {"href", "src", "cite"}
#: Bytes of a batch that are Python objects at once (or one row that has more), and rows at most.
BYTES_AT_ONCE, ROWS_AT_ONCE = 1 << 20, 256
CLEANED = "html string, text string, images array<struct<src:string,alt:string>>"
FACTS = "title string, headings array<struct<tag:string,text:string>>, links array<struct<href:string,text:string>>, metas map<string,string>, times array<string>, paragraphs array<string>, main string, ids map<string,string>, articles array<struct<title:string,href:string,tags:array<string>,date:string>>"


def joined(base: str, url: str) -> str:
    try:
        return urljoin(base, url)
    except ValueError:  # a host that can't be one
        return url


def may_link(url: str) -> bool:
    """Whether a URL has an allowed scheme or none; blanks and controls don't count, as browsers skip them."""
    plain = re.sub(r"[\x00-\x20\x7f-\xa0\s]+", "", url).lower()
    m = re.match(r"([a-z][a-z0-9+.-]*):(?!\d+(?:/|$))", plain)
    return m is None or m[1] in SCHEMES


def _attributes(node: Node, base: str) -> dict[str, str]:
    """The attributes that a letter may have, with absolute links."""
    found = dict(node.attributes)
    if node.tag == "a" and "href" in found and not found["href"].startswith(("http://", "https://", "mailto:", "#")):
        found |= {"href": joined(base, found["href"]), "target": "_blank", "rel": "noopener noreferrer"}
    if node.tag == "img" and "src" in found and not found["src"].startswith(("http://", "https://", "data:")):
        found["src"] = joined(base, found["src"])
    kept = ATTRIBUTES["*"] | ATTRIBUTES.get(node.tag, set())
    return {k: "" if k == "style" else v for k, v in found.items() if k in kept and (k not in LINKS or may_link(v))}


def clean_page(page: str | None, base: str) -> dict:
    """A page's body as HTML for letters, its text nodes by line, and its pictures."""
    base = f"{base.rstrip('/')}/"
    out, texts, images, run = [], [], [], []

    def emit(markup: str) -> None:
        if t := "".join(run).strip():
            texts.append(t)
        run.clear()
        out.append(markup)

    todo: list = [markup.parse(page or "")[1]]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            emit(f"</{x[0]}>")
        elif isinstance(x, str):
            run.append(x)
            out.append(escape(x, quote=False))
        elif x.tag not in DROPPED:
            if x.tag in ALLOWED:
                own = _attributes(x, base)
                if x.tag == "img" and own.get("src"):
                    images.append({"src": own["src"], "alt": x.attributes.get("alt", "")})
                emit(f"<{x.tag}{''.join(f' {k}="{escape(v)}"' for k, v in own.items())}>")
                if x.tag not in markup.VOID:
                    todo.append((x.tag,))
            todo += reversed(x.children)
    emit("")
    return {"html": "".join(out), "text": "\n".join(texts), "images": images}


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few bytes, so that what a task holds as Python objects doesn't grow with its rows."""
    for batch in batches:
        step = max(1, min(ROWS_AT_ONCE, batch.num_rows * BYTES_AT_ONCE // max(1, batch.nbytes)))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def _mapped(df: DataFrame, source: Column, name: str, kind: str | None, arrow: pa.DataType, each) -> DataFrame:
    """``df`` with a column ``name`` (a struct of ``kind``, or without one a string) that ``each`` makes from ``source``; null only where ``each`` gives it."""
    spot = f"{name}_source"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at = batch.schema.get_field_index(spot)
            column = pa.array(map(each, batch.column(at).to_pylist()), arrow)
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), column], names=[*(batch.schema.names[i] for i in kept), name])

    return df.withColumn(spot, source).mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"{name} {f'struct<{kind}>' if kind else 'string'}").fields]))


_IMAGES = pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string())]))


def clean(df: DataFrame, page: str, base: Column, name: str = "cleaned") -> DataFrame:
    """``df`` with the struct ``name``: html, text, excerpt, word_count, reading_time_minutes and images of the cleaned page."""
    arrow = pa.struct([("html", pa.string()), ("text", pa.string()), ("images", _IMAGES)])
    kind = "html:string,text:string,images:array<struct<src:string,alt:string>>"
    d = _mapped(df, F.struct(F.col(page).alias("page"), base.alias("base")), name, kind, arrow, lambda x: clean_page(x["page"], x["base"] or ""))
    words = T.word_count(F.col(f"{name}.text"))
    return d.withColumn(name, F.struct(F.col(f"{name}.html"), F.col(f"{name}.text"), T.excerpt(F.col(f"{name}.text")).alias("excerpt"), words.alias("word_count"), T.reading_minutes(words).alias("reading_time_minutes"), F.col(f"{name}.images")))


class _Facts(HTMLParser):
    """One pass over a page; texts of open headings, links and paragraphs gather side by side."""

    HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.headings, self.links, self.metas, self.times, self.paragraphs, self.ids = None, [], [], {}, [], [], {}
        self.gather: dict[str, list] = {}
        self.marks: dict[str, list[int]] = {}
        self.spans: dict[str, tuple[int, int]] = {}
        self.div: tuple[int, int] | None = None
        self.articles: list[_Article] = []
        self.around: list[_Article] = []  # open ones
        self.depth = 0
        self.muted = 0
        self.page = page
        self.lines = [0]
        for line in page.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(page)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        end = self._at() + len(self.get_starttag_text() or "")
        if tag in ("script", "style"):
            self.muted += 1
        if tag == "meta" and (key := a.get("property") or a.get("name")):
            self.metas.setdefault(key.lower(), a.get("content", ""))
        if tag == "time" and a.get("datetime"):
            self.times.append(a["datetime"])
        if tag == "p" and "p" in self.gather:
            self._done("p")
        if tag in self.HEADINGS or tag in ("a", "p", "title"):
            self.gather[tag] = [a.get("href"), [], self._at()]
        if tag == "article":
            self.around.append(_Article())
            self.articles.append(self.around[-1])
        for article in self.around:
            article.start(tag, a)
        if a.get("id") and tag not in markup.VOID:
            self.gather.setdefault(f"#{a['id']}", [tag, [], 0])
        if tag in ("article", "main", "body"):
            self.marks.setdefault(tag, []).append(end)
        if tag == "div":
            self.depth += 1
            if self.div is None and ({"content", "entry-content", "post-content"} & {*a.get("class", "").split(), a.get("id", "")}):
                self.div = (end, self.depth)

    def _done(self, tag: str, end: int | None = None) -> None:
        href, texts, start = self.gather.pop(tag)
        text = "".join(texts).strip()
        if tag == "title":
            self.title = text if self.title is None else self.title
        elif tag == "a":
            self.links.append({"href": href, "text": text})
        elif tag == "p":
            if text:
                self.paragraphs.append(self.page[start : end if end is not None else self._at()].strip())
        else:
            self.headings.append({"tag": tag, "text": text})

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.muted = max(0, self.muted - 1)
        for article in self.around:
            article.end(tag)
        if tag == "article" and self.around:
            self.around.pop()
        if tag in self.gather:
            self._done(tag, self._at() + len(tag) + 3)
        for key in [k for k, v in self.gather.items() if k[0] == "#" and v[0] == tag]:
            self.ids.setdefault(key[1:], "".join(self.gather.pop(key)[1]).strip())
        if self.marks.get(tag):
            self.spans.setdefault(tag, (self.marks[tag].pop(), self._at()))
        if tag == "div":
            if self.div and self.div[1] == self.depth and "div" not in self.spans:
                self.spans["div"] = (self.div[0], self._at())
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if not self.muted:
            for g in self.gather.values():
                g[1].append(data)
            for article in self.around:
                article.text(data)


class _Article:
    """What an archive page tells of one post: the link in its first title heading, its tag links, and its date."""

    def __init__(self) -> None:
        self.heading: str | None = None  # the first one's tag, while it is open
        self.seen = False
        self.title: list[str] | None = None
        self.href: str | None = None
        self.link: list[str] | None = None  # of the open link, if it is to be a title or a tag
        self.tags: list[list[str]] = []
        self.dated: list[str] | None = None
        self.date_tag: str | None = None
        self.time: str | None = None

    def start(self, tag: str, a: dict[str, str]) -> None:
        if tag in ("h1", "h2", "h3") and not self.seen and ("class" not in a or "title" in a["class"]):
            self.heading, self.seen = tag, True
        if tag == "a" and "href" in a:
            self.link = []
            if self.heading and self.href is None:
                self.href, self.title = a["href"], self.link
            if "/tag/" in a["href"] or "/category/" in a["href"]:
                self.tags.append(self.link)
        if self.dated is None and "date" in a.get("class", "") and tag not in markup.VOID:
            self.dated, self.date_tag = [], tag
        if tag == "time" and self.time is None and a.get("datetime"):
            self.time = a["datetime"]

    def end(self, tag: str) -> None:
        if tag == self.heading:
            self.heading = None
        if tag == "a":
            self.link = None
        if tag == self.date_tag:
            self.date_tag = None

    def text(self, data: str) -> None:
        if self.link is not None:
            self.link.append(data)
        if self.date_tag:
            self.dated.append(data)

    def told(self) -> dict:
        join = lambda parts: "".join(parts or []).strip()
        return {"title": join(self.title) if self.href is not None else None, "href": self.href, "tags": [join(t).lower() for t in self.tags], "date": join(self.dated) or self.time}


def page_facts(page: str | None) -> dict:
    f = _Facts(markup.whole(page or ""))  # the standard parser would read a cut-off tag again and again
    span = next((f.spans[t] for t in ("article", "main", "div", "body") if t in f.spans), (0, len(f.page)))
    return {"title": f.title, "headings": f.headings, "links": f.links, "metas": list(f.metas.items()), "times": f.times, "paragraphs": f.paragraphs, "main": f.page[slice(*span)].strip(), "ids": list(f.ids.items()), "articles": [a.told() for a in f.articles]}


_FACTS = pa.struct([
    ("title", pa.string()),
    ("headings", pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))),
    ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))),
    ("metas", pa.map_(pa.string(), pa.string())),
    ("times", pa.list_(pa.string())),
    ("paragraphs", pa.list_(pa.string())),
    ("main", pa.string()),
    ("ids", pa.map_(pa.string(), pa.string())),
    ("articles", pa.list_(pa.struct([("title", pa.string()), ("href", pa.string()), ("tags", pa.list_(pa.string())), ("date", pa.string())]))),
])


def facts(df: DataFrame, page: str, name: str = "facts") -> DataFrame:
    kind = FACTS.replace(" string", ":string").replace(" array", ":array").replace(" map", ":map").replace(", ", ",")
    return _mapped(df, F.col(page), name, kind, _FACTS, page_facts)


def main_text(df: DataFrame, page: str, name: str = "main") -> DataFrame:
    """``df`` with the text of the page's densest part, a line a block; null for a null page."""
    return _mapped(df, F.col(page), name, None, pa.string(), lambda x: None if x is None else markup.shown(markup.main_part(markup.parse(x)[1])))


def heading(found: Column, tag: str) -> Column:
    """The first heading of that level, null without one."""
    return F.nullif(F.try_element_at(F.filter(found["headings"], lambda h: h["tag"] == tag), F.lit(1))["text"], F.lit(""))


def title_of(found: Column) -> Column:
    """h1, else h2, else the title element."""
    return F.coalesce(heading(found, "h1"), heading(found, "h2"), F.nullif(found["title"], F.lit("")))


#: Metas that may hold a page's date, in the order they are tried.
DATE_METAS = ("article:published_time", "datepublished", "date", "dc.date", "pubdate")


def published(found: Column, times_first: bool = True, metas: tuple[str, ...] = DATE_METAS) -> Column:
    """The first time element's date-time and the metas, in either order; null without any."""
    time = F.try_element_at(found["times"], F.lit(1))
    named = [F.nullif(F.try_element_at(found["metas"], F.lit(m)), F.lit("")) for m in metas]
    return F.coalesce(*([time, *named] if times_first else [*named, time]))


def tags_of(found: Column) -> Column:
    """Texts of links to tag or category pages, in lower case, each once."""
    return F.array_distinct(F.transform(F.filter(found["links"], lambda x: x["href"].rlike("/(tag|category)/") & (x["text"] != "")), lambda x: F.lower(x["text"])))


def ampersands_escaped(page: Column, *names: str) -> Column:
    """A page whose only references are ``&amp;`` and those named: other ampersands, as of a reference that is cut off, stand for themselves."""
    return F.regexp_replace(page, f"&(?!(?:{'|'.join(('amp', *names))});)", "&amp;")


def entity_text(fragment: Column) -> Column:
    """A fragment's text: tags left out, entities resolved; one without entities stays in the JVM."""
    bare = F.regexp_replace(fragment, "<[^>]*>", "")
    return F.when(bare.contains("&"), _unescaped(F.when(bare.contains("&"), bare))).otherwise(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""))


@F.pandas_udf(StringType())
def _unescaped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([None if x is None else unescape(x).strip() for x in part], dtype=object)
