"""Text, date, URL and HTML functions against literal cases and plain restatements."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriatim.functions import dates, html, text, urls


def values(spark, rows, *columns):
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


@pytest.fixture(autouse=True, scope="module")
def _columns(spark):
    """Columns need a running session."""
    global X
    X = F.col("x")


def test_slugs(spark):
    rows = ["Hello World", "What's up? (Part 2)", "A" * 100, "  -a - b-  ", "Ünï_çode 9", "", None]
    assert values(spark, rows, text.slugify(X)) == ["hello-world", "whats-up-part-2", "a" * 80, "a-b", "ünï_çode-9", "", None]


def test_excerpts(spark):
    rng = random.Random(1)
    rows = ["Short.", "", "a" * 300, "word " * 100] + ["".join(rng.choice(["a", "b ", ". ", "! ", "? ", "\n"]) * rng.randint(1, 30) for _ in range(rng.randint(1, 30))) for _ in range(400)]

    def plain(t):
        head = t[:250]
        for c in ".!?":
            if (i := head.rfind(c, 0, 200)) > 50:
                return head[: i + 1]
        if len(head) > 200 and (i := head.rfind(" ", 0, 200)) > 50:
            return head[:i] + "..."
        return head[:200] + ("..." if len(t) > 200 else "")

    assert values(spark, rows, text.excerpt(X)) == [plain(t) for t in rows]
    assert values(spark, ["one two", "x" * 300], text.excerpt_words(X)) == ["one...", "x" * 200 + "..."]
    assert values(spark, ["a b", "w" * 120 + " " + "v" * 60, "w " * 20 + "v" * 200], text.excerpt_short(X)) == ["a b", "w" * 120 + "...", ("w " * 20 + "v" * 200)[:150] + "..."]


def test_counts(spark):
    rows = ["one two three four five", "word " * 500, "one", "", None, "a\x1cb\xa0c", " lead and trail "]
    words = text.word_count(X)
    assert values(spark, rows, words, text.reading_minutes(words), text.reading_minutes_floor(words)) == [(len((t or "").split()), max(1, round(len((t or "").split()) / 250)), max(1, len((t or "").split()) // 250)) for t in rows]


def test_progress(spark):
    df = spark.createDataFrame([(i, n) for n in range(41) for i in range(n + 1)], "i int, n int")
    for i, n, even, up in df.select("i", "n", text.progress_percent(F.col("i"), F.col("n")), text.progress_percent_half_up(F.col("i"), F.col("n"))).collect():
        assert even == (round(i / n * 100) if n else 0)
        assert up == (int(i / n * 100 + 0.5) if n else 0)


def test_letters(spark):
    assert values(spark, ["https://a/b", "https://a/b?c=1", "", None], text.with_campaign(X, "s")) == ["https://a/b?utm_source=s&utm_medium=email&utm_campaign=drip", "https://a/b?c=1&utm_source=s&utm_medium=email&utm_campaign=drip", "", ""]
    assert values(spark, ["{{later}}"], text.render(F.lit("<{{first}}>{{later}}"), {"first": X, "later": F.lit("L")})) == ["<L>L"]
    assert values(spark, ["Ann", "", None], text.address(X, F.lit("a@b"))) == ["Ann <a@b>", "a@b", "a@b"]
    assert values(spark, ["a b&c!'()*~é"], text.url_component(X)) == ["a%20b%26c!'()*~%C3%A9"]


def test_scans_and_paragraphs(spark):
    assert values(spark, ["a\n - 12 - \nb\nFOR PRIVATE DISTRIBUTION ONLY\nc\n\n\n\nd becture"], text.clean_scan(X, {"becture": "Lecture"})) == ["a\nb\nc\n\nd Lecture"]
    assert values(spark, ["a <b>\nc  d\n\n\n\n'q' & r"], text.paragraphs_html(X)) == ["<p>a &lt;b&gt; c d</p>\n<p>&#x27;q&#x27; &amp; r</p>"]
    t = "A first para-\ngraph that is wrapped\nover lines.\r\n\r\nFigure 3 is left out of the result.\n\nshort\n\nPART II and its title here\n\n12 34 5.6 78 90 12 34 56 78\n\nDOI: 10.1000/182 something"
    assert values(spark, [t], F.array_join(text.paragraphs(X), "|")) == ["A first paragraph that is wrapped over lines."]
    assert values(spark, ["x (1, 2–3) y (12) (1234)"], text.strip_citations(X)) == ["x  y  (1234)"]
    assert values(spark, ["T\nhe end\nAB\nx\nA\nB"], text.rejoin_capitals(X)) == ["The end\nABx\nA\nB"]
    header = "42 The Long Road\nThe Long Road 43\nLONG ROADS, 44\n\nDOI: 1\nKept 7 lines"
    assert values(spark, [header], text.without_page_headers(X, ["the long road"])) == ["\nKept 7 lines"]
    assert values(spark, ["It’s — “A” long-ish heading", "x" * 30 + " " + "y" * 40], text.section_slug(F.lit("ch1"), X)) == ["ch1-its-a-long-ish-heading", "ch1-" + "x" * 30]
    assert values(spark, ["The Same Subject Continued(The X). For the Daily Packet. 1787", "From the People to the Union From the New York Journal"], text.subject_cut(X, [" For the ", " From the "], ["Journal", "Packet"])) == ["The Same Subject Continued (The X)", "From the People to the Union"]
    assert values(spark, ["JAY", "HAMILTON AND JAY", "JAY SAID"], text.byline(X, ["HAMILTON", "JAY"])) == ["Jay", "Hamilton and Jay", None]


def test_dates(spark):
    cases = {
        "2023-01-15T10:30:00": "2023-01-15T10:30:00",
        "2023-01-15T10:30:00+02:00": "2023-01-15T10:30:00+02:00",
        "2023-01-15T10:30:00Z": "2023-01-15T10:30:00+00:00",
        "2023-01-15T10:30:00.123456-0500": "2023-01-15T10:30:00.123456-05:00",
        "2023-01-15": "2023-01-15T00:00:00",
        " January 15, 2023 ": "2023-01-15T00:00:00",
        "Jan 5, 2023": "2023-01-05T00:00:00",
        "15 January 2023": "2023-01-15T00:00:00",
        "5 Jan 2023": "2023-01-05T00:00:00",
        "2023/1/5": "2023-01-05T00:00:00",
        "not a date": "not a date",
        "2023-02-31": "2023-02-31",
        "": None,
        None: None,
    }
    assert values(spark, list(cases), dates.parse_date(X)) == list(cases.values())
    t = "On March 3, 2001, and then July 14 2002 it ended"
    assert values(spark, [t, "none"], dates.first_date(X), dates.last_date(X)) == [("March 3, 2001", "2002-07-14T00:00:00"), (None, None)]
    assert values(spark, ["May 1st, 2020", "August 2nd, 2020", "x"], dates.month_date(X), dates.month_date(X, keep_august=True)) == [("2020-05-01T00:00:00", "2020-05-01T00:00:00"), ("Augu 2, 2020", "2020-08-02T00:00:00"), (None, None)]


def test_next_send(spark):
    zones, rows = ["America/New_York", "Europe/Berlin", "Asia/Kolkata", "UTC"], []
    for z in zones:
        for start in ("2024-03-08 05:10:00", "2024-10-31 23:50:00", "2024-07-01 12:00:00"):
            for h in range(0, 120, 7):
                for f in (1, 7, 14):
                    for d in (None, 0, 3, 6):
                        rows.append((datetime.fromisoformat(start) + timedelta(hours=h), f, d, 9, z))
    df = spark.createDataFrame(rows, "now timestamp_ntz, f int, d int, h int, z string")
    c = F.col
    got = df.select("now", "f", "d", "z", dates.next_send_local(c("now").cast("timestamp"), c("f"), c("d"), c("h"), c("z")).cast("timestamp_ntz").alias("a"), dates.next_send_instant(c("now").cast("timestamp"), c("f"), c("d"), c("h"), c("z")).cast("timestamp_ntz").alias("b")).collect()
    utc = ZoneInfo("UTC")
    for r in got:
        zone, now = ZoneInfo(r["z"]), r["now"].replace(tzinfo=utc)
        day = (now.astimezone(zone).replace(tzinfo=None) + timedelta(days=r["f"])).date()
        while r["d"] is not None and r["f"] >= 7 and (day.weekday() + 1) % 7 != r["d"]:
            day += timedelta(days=1)
        assert r["a"] == datetime(day.year, day.month, day.day, 9, tzinfo=zone).astimezone(utc).replace(tzinfo=None)
        day = (now + timedelta(days=r["f"])).astimezone(zone).date()
        at = datetime(day.year, day.month, day.day, 9, tzinfo=zone).astimezone(utc)
        weekday = (day.weekday() + 1) % 7
        while r["d"] is not None and r["f"] >= 7 and weekday != r["d"]:
            at, weekday = at + timedelta(days=1), (weekday + 1) % 7
        assert r["b"] == at.replace(tzinfo=None)


def test_urls(spark):
    rows = ["https://a.org/2020/post", "https://a.org/", "https://b.org/x", "https://a.org/tag/x", "https://a.org:80/x/y", "https://a.org/about-time", "https://a.org/abc", "https://a.org/abcdefghijkl"]
    assert values(spark, rows, urls.is_post(X, F.lit("https://a.org"))) == [True, False, False, False, False, False, True, True]
    assert values(spark, rows, urls.is_archive_link(X)) == [True, False, False, True, True, False, False, True]
    assert values(spark, ["/about", "x/y", "https://c.org/z", None, "#f"], urls.join(F.lit("https://a.org/b/"), X)) == ["https://a.org/about", "https://a.org/b/x/y", "https://c.org/z", None, "https://a.org/b/#f"]
    assert values(spark, ["https://a/p/q.html/", "https://a/"], urls.slug_of(X)) == ["q", ""]
    assert values(spark, ["/1980/x.html"], urls.path_slug(X)) == ["1980-x"]
    assert values(spark, ["https://a/?freq=14", "https://a/"], urls.parameter(X, "freq", "7")) == ["14", "7"]


PAGE = """<html><head><title>T | Site</title><meta property="article:published_time" content="2020-01-02"></head><body><nav>menu</nav><script>x()</script>
<article><h1>Head</h1><!-- note --><p class="c" id="i">One <a href="/about">link</a> <a href="https://x.org">abs</a></p><img src="/img/a.jpg" alt="A"><img src="data:image/png;base64,xx">
<iframe src="f"></iframe><p>Two<br>lines &amp; more</p><a href="/tag/Go">Go</a><time datetime="2021-05-06">x</time></article><footer>foot</footer></body></html>"""


def test_clean(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("",), ("<p>" + "w " * 20000 + "<b>open",)], "page string")
    rows = [r["cleaned"] for r in html.clean(df, "page", F.lit("https://b.org/")).collect()]
    out = rows[0]
    for gone in ("script", "nav", "iframe", "note", "foot", "class="):
        assert gone not in out["html"]
    assert '<a href="https://b.org/about" target="_blank" rel="noopener noreferrer">link</a>' in out["html"]
    assert '<a href="https://x.org">abs</a>' in out["html"]
    assert '<p id="i">' in out["html"]
    assert [tuple(i) for i in out["images"]] == [("https://b.org/img/a.jpg", "A")]
    assert out["text"].split("\n")[:3] == ["Head", "One", "link"]
    assert out["word_count"] == len(out["text"].split())
    assert (rows[1]["html"], rows[1]["word_count"], rows[1]["reading_time_minutes"]) == ("", 0, 1)
    assert rows[3]["word_count"] == 20001
    assert rows[3]["html"].endswith("<b>open</b></p>")


def test_parts_of_batches():
    """What is turned to Python objects at once is bounded by bytes and rows, whatever a batch holds; no row is lost."""
    for rows, size in ((5000, 10_000), (5000, 3), (3, 3 << 20), (0, 1)):
        batch = pa.RecordBatch.from_pydict({"i": pa.array(range(rows), pa.int64()), "x": pa.array(["x" * size] * rows, pa.string())})
        found = list(html.parts([batch]))
        assert [i for b in found for i in b.column("i").to_pylist()] == list(range(rows))
        assert all(b.num_rows == 1 or (b.nbytes <= html.BYTES_AT_ONCE and b.num_rows <= html.ROWS_AT_ONCE) for b in found)


def test_facts(spark):
    df = html.facts(spark.createDataFrame([(PAGE,), (None,), ("<div class='x content'><div>in</div>side</div>out",)], "page string"), "page")
    f = F.col("facts")
    rows = df.select(html.title_of(f), html.published(f), html.published(f, times_first=False), html.tags_of(f), F.size(f["paragraphs"]), f["main"]).collect()
    assert tuple(rows[0])[:5] == ("Head", "2021-05-06", "2020-01-02", ["go"], 2)
    assert rows[0][5].startswith("<h1>Head</h1>")
    assert tuple(rows[1]) == (None, None, None, [], 0, "")
    assert rows[2][5] == "<div>in</div>side"
    assert [r[0] for r in spark.createDataFrame([("A &amp; <i>B</i>",)], "x string").select(html.entity_text(X)).collect()] == ["A & B"]


@pytest.mark.parametrize("name", ["a-b", "x"])
def test_titles(spark, name):
    assert values(spark, [name], text.title_from_slug(X)) == [" ".join(w.capitalize() for w in re.split("-", name))]


def test_section_slugs_take_the_whole_text(spark, tmp_path):
    from seriatim.plans.scalar import f02_section_slugs

    d = spark.createDataFrame([(1, "é" * 80 + " " + "word " * 13 + "end")], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in f02_section_slugs(spark, str(tmp_path)).collect()] == [(1, "ch1-" + "-".join(["word"] * 12))]


def test_joined_urls_as_the_standard_library(spark):
    """Every form of reference against several bases."""
    from urllib.parse import urljoin

    bases = ["https://a.org", "https://a.org/", "https://a.org/b/c.html?q=1#f", "http://a.org/b/", "https://a.org:8080/x/y/z"]
    hrefs = ["", "c", "./c", "../c", "../../c", "../../../c", "/c/d", "/c/../d/./e", "//b.org/c", "?q=2", "#g", "c?q=3#h", "c/", "..", ".", "d/..", "d/.", "https://z.org/a/../b", "mailto:x@y.org", "c/d/../../e", "/", "a:b/c"]
    d = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    for r in d.select("base", "href", urls.join(F.col("base"), F.col("href")).alias("url")).collect():
        assert r["url"] == urljoin(r["base"], r["href"]), (r["base"], r["href"])


def test_articles_of_an_archive(spark):
    one = "<article class='x'><h2 class='post-title'><a href='/p/1'>One &amp; two</a></h2><a href='/tag/a'>A</a><a href='/category/b'> B </a><time datetime='2020-01-02'>x</time></article>"
    other = "<article><h3>no link</h3><h2><a href='/p/2'>later heading</a></h2></article><article><h1 class='hero'>x</h1><h3><a href='p/3'>Three</a></h3><p class='the-date'>May 1, 2020</p></article>"
    found = html.page_facts(one + other + "<article></article>")["articles"]
    assert found == [
        {"title": "One & two", "href": "/p/1", "tags": ["a", "b"], "date": "2020-01-02"},
        {"title": None, "href": None, "tags": [], "date": None},
        {"title": "Three", "href": "p/3", "tags": [], "date": "May 1, 2020"},
        {"title": None, "href": None, "tags": [], "date": None},
    ]
