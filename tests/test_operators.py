"""Transitions, merges, sources and streams on small tables."""

from __future__ import annotations

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seriatim import schemas
from seriatim.operators import catalogue, checks, delivery, merge
from seriatim.sources import files
from seriatim.streaming import events as S

NOW = datetime(2024, 1, 10, 12)


@pytest.fixture(autouse=True, scope="module")
def _columns(spark):
    """Columns need a running session."""
    global AT
    AT = F.lit("2024-01-10 12:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def state(spark):
    def subscription(i, blog, at, cursor=0, **more):
        row = {"id": i, "subscriber_id": f"u{i}", "blog_id": blog, "feed_id": None, "current_post_index": cursor, "frequency_days": 7, "preferred_day": None, "preferred_hour": 9, "timezone": "UTC", "next_send_at": at, "is_active": True, "is_completed": False}
        return row | more

    rows = [subscription("1", "b", datetime(2024, 1, 1)), subscription("2", "b", datetime(2024, 2, 1)), subscription("3", "b", None), subscription("4", "b", datetime(2024, 1, 1), cursor=1), subscription("5", "b", datetime(2024, 1, 1), is_active=False), subscription("6", "b", datetime(2024, 1, 1), cursor=5), subscription("7", "x", datetime(2024, 1, 1)), subscription("8", "b", datetime(2024, 1, 1))]
    subs = spark.createDataFrame(rows, schemas.SUBSCRIPTIONS)
    people = spark.createDataFrame([{"id": f"u{i}", "email": f"{i}@x", "name": None, "is_confirmed": i != 8} for i in range(1, 9)], schemas.SUBSCRIBERS)
    blogs = spark.createDataFrame([{"id": "b", "slug": "b", "name": "B", "post_count": 2}], schemas.BLOGS)
    posts = spark.createDataFrame([{"id": f"p{i}", "blog_id": "b", "title": f"T{i}", "content_html": "<p>{{app_url}}</p>", "original_url": "https://b/p", "post_index": i} for i in (1, 2)], schemas.POSTS)
    return subs, people, blogs, posts


def test_due_and_mark(state):
    subs, people, blogs, posts = state
    items = delivery.due(subs, people, blogs, posts, AT)
    assert sorted((r["subscription_id"], r["post_id"], r["post_index"], r["total_posts"]) for r in items.collect()) == [("1", "p1", 1, 2), ("4", "p2", 2, 2)]
    assert [r["subscription_id"] for r in delivery.stalled(subs, posts, AT).orderBy("subscription_id").collect()] == ["6", "7"]
    letters = delivery.outbox(items, "{{post_content}} {{progress_pct}}% {{unsubscribe_url}}", "https://app", "s").orderBy("subscription_id").collect()
    assert [r["html"] for r in letters] == ["<p>https://app</p> 50% https://app/unsubscribe?sid=1", "<p>https://app</p> 100% https://app/unsubscribe?sid=4"]
    assert delivery.outbox(items, "x", "a", "s", limit=1).count() == 1
    assert delivery.outbox(items, "x", "a", "s", limit=0).count() == 2
    sent = items.select("subscription_id", "post_id", F.lit("m").alias("message_id"))
    new, log = delivery.mark_sent(subs, blogs, sent, AT)
    assert new.schema == subs.schema
    rows = {r["id"]: r for r in new.collect()}
    assert (rows["1"]["current_post_index"], rows["1"]["is_completed"], rows["1"]["next_send_at"]) == (1, False, datetime(2024, 1, 17, 9))
    assert (rows["4"]["current_post_index"], rows["4"]["is_completed"]) == (2, True)
    assert rows["2"].asDict() == {r["id"]: r for r in subs.collect()}["2"].asDict()
    assert log.count() == 2
    assert delivery.due(new, people, blogs, posts, AT).count() == 0
    assert S.deliver(items, log).count() == 0


def test_changes(state):
    subs = state[0]
    ids = subs.sparkSession.createDataFrame([("1",), ("5",)], "id string")
    rows = {r["id"]: r for r in delivery.toggle(subs, ids, AT).collect()}
    assert (rows["1"]["is_active"], rows["1"]["paused_at"]) == (False, NOW)
    assert (rows["5"]["is_active"], rows["5"]["paused_at"]) == (True, None)
    log = subs.sparkSession.createDataFrame([{"id": "l1", "subscription_id": "1"}, {"id": "l2", "subscription_id": "2"}], schemas.EMAIL_LOG)
    kept, rest = delivery.unsubscribe(subs, log, ids)
    assert (kept.count(), [r["id"] for r in rest.collect()]) == (6, ["l2"])
    changes = subs.sparkSession.createDataFrame([("1", 14, 3, None)], "id string, frequency_days int, preferred_day int, preferred_hour int")
    row = {r["id"]: r for r in delivery.set_preferences(subs, changes, AT).collect()}["1"]
    assert (row["frequency_days"], row["preferred_day"], row["preferred_hour"], row["next_send_at"]) == (14, 3, 9, datetime(2024, 1, 24, 9))


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", None)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, x string")
    assert sorted(map(tuple, merge.upsert(old, new, ["k"]).collect())) == [(1, "a", 10), (2, "c", None), (3, "d", None)]
    assert sorted((r["k"], r["x"]) for r in merge.upsert(old, new, ["k"], update=[]).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(r["k"] for r in merge.insert_absent(old.select("k", "x"), new, ["k"]).collect()) == [1, 2, 3]
    board = spark.createDataFrame([{"id": "1", "url": "HTTP://A", "vote_count": 2, "status": "pending"}], schemas.BLOG_REQUESTS)
    votes = spark.createDataFrame([("http://a", 1), ("http://B", 2), ("http://b", 1)], "url string, ts int")
    assert sorted((r["url"], r["vote_count"]) for r in merge.count_votes(board, votes, AT).collect()) == [("HTTP://A", 3), ("http://b", 2)]
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, p int")
    assert sorted((r["id"], r["p"]) for r in merge.set_null(child, "p", old, "k").collect()) == [(1, 1), (2, None), (3, None)]
    assert sorted(r["id"] for r in merge.cascade(child, "p", old, "k").collect()) == [1, 3]


def test_catalogue(spark):
    posts = spark.createDataFrame([("b", ["y", "x", "x"]), ("b", ["x"]), ("c", [])], "blog_id string, tags array<string>")
    assert sorted(map(tuple, catalogue.tag_counts(posts).collect())) == [("b", "x", 2), ("b", "y", 1)]
    assert sorted((r[0], r[1]) for r in catalogue.blog_tags(posts).collect()) == [("b", ["x", "y"]), ("c", [])]
    feeds = spark.createDataFrame([("b", "n1", "s1"), ("A", "n2", "s2"), (None, "n3", "s3"), ("a", "n0", "s0")], "author string, name string, slug string")
    assert [r["author"] for r in catalogue.by_author(feeds, ["A"]).orderBy("place").collect()] == ["a", "b", "Unknown", "A"]
    assert catalogue.single(posts.filter("blog_id = 'c'"))["blog_id"] == "c"
    assert catalogue.single(posts.filter("blog_id = 'z'"), required=False) is None
    with pytest.raises(ValueError, match="several"):
        catalogue.single(posts)
    assert checks.repeated_keys(posts, [F.col("blog_id")]).collect()[0]["n"] == 2
    themes = files.theme_map(spark, {"t1": ["/a", "/b"], "t2": ["/a"]})
    assert sorted(map(tuple, catalogue.inverted(themes).collect())) == [("/a", ["t1", "t2"]), ("/b", ["t1"])]


def test_file_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"title": "T", "url": "u", "post_index": 1}, {"title": "S", "tags": ["x"]}]))
    rows = files.posts_file(spark, str(tmp_path / "p.json")).collect()
    assert [(r["title"], r["tags"], r["post_index"]) for r in rows] == [("T", [], 1), ("S", ["x"], None)]
    d = spark.createDataFrame([("b", 2, "y"), ("b", 1, "x")], "blog string, n int, t string")
    files.write_json_array(d, str(tmp_path / "out"), [F.col("n")], "blog")
    assert json.loads(spark.read.text(str(tmp_path / "out/blog=b"), wholetext=True).first()[0]) == [{"n": 1, "t": "x"}, {"n": 2, "t": "y"}]
    head = '<?xml version="1.0"?>'
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    maps = {"i": f"{head}<sitemapindex {ns}><sitemap><loc>m1</loc></sitemap></sitemapindex>", "m1": f"{head}<urlset {ns}><url><loc> https://a/x </loc></url><url><loc>https://a/y</loc></url></urlset>"}
    known = spark.createDataFrame(list(maps.items()), "url string, xml string")
    found = files.sitemap(lambda urls: urls.join(known, "url"), spark.createDataFrame([("i",)], "url string"), str(tmp_path / "maps"))
    assert sorted(r["url"] for r in files.sitemap_pages(found).collect()) == ["https://a/x", "https://a/y"]
    body = json.dumps([{"title": {"rendered": "A &amp; B"}, "content": {"rendered": "<p>x</p>"}, "link": "l", "slug": "s", "date": "2020-01-02T03:04:05"}, {"link": "m"}])
    got = files.rest_posts(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r["title"], r["url"], r["published_at"]) for r in got] == [("A & B", "l", "2020-01-02T03:04:05"), ("", "m", None)]
    index = json.dumps([["timestamp", "original", "statuscode"], ["1", "u", "200"], ["2", "u", "200"], ["3", "v", "200"]])
    assert [(r["original"], r["timestamp"]) for r in files.archive_index(spark.createDataFrame([(index,)], "body string")).collect()] == [("u", "1"), ("v", "3")]
    assert [r["url"] for r in files.numbered_urls(spark.range(1, 86).select(F.col("id").alias("number")), "f%02d").orderBy("number").limit(1).collect()] == ["f01"]
    assert files.first_with_rows([lambda: spark.read.parquet(str(tmp_path / "none")), lambda: d.limit(0), lambda: d]).count() == 2
    assert files.first_with_rows([lambda: d.limit(0)]) is None


def test_books(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("OEBPS/chapter-2-second.html", "<h2 class='chapter-title'>Second</h2><p>Text. March 4, 2011 and May 6, 2012</p>")
        z.writestr("OEBPS/chapter-1-slug-9-first.html", "<p>no title</p>")
        z.writestr("OEBPS/other.html", "x")
    got = files.book_posts(files.books(spark, str(tmp_path / "b.epub")), "https://b").collect()
    assert [(r["post_index"], r["title"], r["slug"], r["published_at"]) for r in got] == [(2, "Second", "second", "2012-05-06T00:00:00")]


def test_papers_and_lectures(spark):
    page = "<h1>The Site</h1><h3>The Subject Continued. For the Daily Packet. Friday, November 2, 1787</h3><h4>HAMILTON AND JAY</h4><p>One.</p><p> </p><p>Two.</p>"
    row = files.numbered_papers(spark.createDataFrame([(3, page)], "number int, html string"), ["Site"], ["HAMILTON", "JAY"], [" For the "], ["Packet"]).first()
    assert tuple(row) == (3, "No. 3: The Subject Continued", "Hamilton and Jay", "November 2, 1787", "<p>One.</p>\n<p>Two.</p>")
    lec = files.lecture_posts(spark.createDataFrame([(1, "A Title", "u", "1964-01-01", "a\n- 1 -\nb\n\nc")], "pos int, title string, url string, date string, raw string"), "tag").first()
    assert (lec["slug"], lec["content_html"], lec["word_count"], lec["tags"]) == ("a-title", "<p>a b</p>\n<p>c</p>", 3, ["tag"])


def test_sections(spark):
    body = "Intro\nThe First—Part\nsome text that is long enough to stay\nSecond part of a heading that wraps\nmore text that is long enough to stay"
    heads = ["The First-Part", "Missing", "Second part of a heading that goes on differently"]
    pages = spark.createDataFrame([(12, body.split("\nSecond")[0]), (13, "Second" + body.split("\nSecond")[1])], "page int, text string")
    chapters = spark.createDataFrame([("ch1", 2, 3)], "chapter string, first int, last int")
    d = files.page_range(chapters, pages, 10).withColumn("headings", F.array(*map(F.lit, heads)))
    got = files.sections(d).orderBy("nth")
    assert [(r["nth"], r["heading"], r["content"]) for r in got.collect()] == [(1, heads[0], "some text that is long enough to stay"), (2, heads[2], "more text that is long enough to stay")]
    posts = files.section_posts(got.withColumn("short_title", F.lit("S")), {heads[0]: "Shown"}).orderBy("nth").collect()
    assert (posts[0]["title"], posts[0]["slug"]) == ("Ch 1: S — Shown", "ch1-shown")


def test_links_and_themes(spark):
    page = "<title>Site · Name</title><a href='/b/one'>One</a><a href='/b/one'>again</a><a href='/b/two'>← back</a><a href='/x'>x</a><main><p>" + "word " * 40 + "</p></main>"
    from seriatim.functions import html

    facts = html.facts(spark.createDataFrame([("https://a.org", page)], "url string, html string"), "html")
    assert [r["title"] for r in files.chapter_links(facts, "/b/").collect()] == ["One"]
    assert sorted(r["url"] for r in files.archive_links(facts, F.col("url")).collect()) == ["https://a.org/b/one", "https://a.org/b/two"]
    themed = files.themed_posts(spark.createDataFrame([("/b/one", page)], "path string, html string"), spark.createDataFrame([("/b/one", ["t"])], "path string, themes array<string>"), "https://a.org").collect()
    assert [(r["title"], r["url"], r["slug"], r["tags"]) for r in themed] == [("Site", "https://a.org/b/one", "b-one", ["t"])]
    links = spark.createDataFrame([(1, "Given", "https://a.org", "An Author")], "pos int, title string, url string, author string")
    got = files.curated_posts(links, spark.createDataFrame([("https://a.org", page)], "url string, html string")).collect()
    assert [(r["title"], r["tags"]) for r in got] == [("Given", ["an-author"])]


def test_streams(spark, tmp_path):
    lines = [{"type": "email.opened", "data": {"email_id": "m1"}}, {"type": "email.opened", "data": {}}, {"type": "email.sent", "data": {"email_id": "m1"}}, {"type": "email.clicked", "data": {"email_id": "m1"}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(map(json.dumps, lines)))
    stream = S.webhook_events(spark.readStream.text(str(tmp_path / "in")), received=F.lit("2024-01-01").cast("timestamp"))
    table = S.KeyedTable(spark, str(tmp_path / "table"), ["message_id"])
    firsts = S.first_events(stream, "email.opened", "email.clicked")
    assert table.read(firsts.schema).count() == 0
    S.run_available(firsts, str(tmp_path / "c"), table.upsert)
    rows = table.read(firsts.schema).collect()
    assert [(r["message_id"], r["opened_at"] is not None, r["clicked_at"] is not None) for r in rows] == [("m1", True, True)]
    once = []
    S.run_available(S.first_events_once(stream, "email.opened", "email.clicked"), str(tmp_path / "c2"), lambda b, n: once.extend(b.collect()), "append")
    assert sorted(r["event_type"] for r in once) == ["email.clicked", "email.opened"]


def test_keyed_table(spark, tmp_path):
    """Batches in turn, one of them twice, equal one merge; only touched buckets are written anew, and old versions go."""
    schema = "id int, x string"
    table = S.KeyedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=4)
    batches = [[(i, f"a{i}") for i in range(40)], [(3, "b3"), (90, "b90")], [(3, "c3")], [(3, "d3")], []]
    for number, rows in enumerate(batches):
        for _ in range(1 + (number == 1)):
            table.upsert(spark.createDataFrame(rows, schema), number)
    want = dict(r for b in batches for r in b)
    assert {r["id"]: r["x"] for r in table.read(schema).collect()} == want
    assert table.read(schema).columns == ["id", "x"]
    folders = sorted(p.relative_to(tmp_path / "t/data").as_posix() for p in (tmp_path / "t/data").glob("v*/bucket=*"))
    assert len([f for f in folders if f.startswith("v0")]) == 4 - len({f.split("/")[1] for f in folders if f.startswith("v1")} | {f.split("/")[1] for f in folders if f.startswith("v3")})
    users = S.KeyedTable(spark, f"file://{tmp_path}/u", ["id"])
    users.insert(spark.createDataFrame([(1, "a"), (1, "b")], schema), 0)
    users.insert(spark.createDataFrame([(1, "c"), (2, "d")], schema), 1)
    assert sorted(map(tuple, users.read(schema).collect())) == [(1, "a"), (2, "d")]


def test_requests_in_order(spark, state):
    """Of several requests for one feed the first by arrival counts, or without one the least, in any run."""
    rows = [("u1", "f", "b", d, None, 9, None, at) for d, at in ((14, 2), (7, 3), (1, 1))]
    asked = spark.createDataFrame(rows, "subscriber_id string, feed_id string, blog_id string, frequency_days int, preferred_day int, preferred_hour int, timezone string, at int").repartition(3)
    assert delivery.subscribe(state[0], asked, AT, [F.asc("at")])[0].first()["frequency_days"] == 1
    assert delivery.subscribe(state[0], asked.drop("at"), AT)[0].first()["frequency_days"] == 1
    assert delivery.subscribe(state[0], asked, AT, [F.desc("at")])[0].first()["frequency_days"] == 7


def test_names_that_clash(spark):
    old = spark.createDataFrame([(1, 5, 6)], "k int, _new int, _old int")
    assert merge.upsert(old, spark.createDataFrame([(1, 7)], "k int, _new int"), ["k"]).collect() == [(1, 7, 6)]
    assert merge.first_by(spark.createDataFrame([(1, 2), (1, 1)], "k int, _r int"), ["k"], [F.asc("_r")]).collect() == [(1, 1)]


def test_ranks_by_bucket(spark):
    """Ranks added up over buckets equal plain ranks, with null groups and buckets too."""
    rows = [(None if i % 7 == 0 else f"g{i % 3}", i * 37 % 1000, i) for i in range(500)]
    d = spark.createDataFrame(rows, "g string, at int, id int").repartition(5)
    order = [F.asc("at"), F.asc("id")]
    plain = catalogue.numbered(d, ["g"], order)
    assert sorted(map(str, catalogue.numbered(d, ["g"], order, bucket=F.floor(F.col("at") / 64)).collect())) == sorted(map(str, plain.collect()))
