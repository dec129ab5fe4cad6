"""The jobs over a store of tables, through the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from seriatim import __main__ as cli
from seriatim import commands
from seriatim.sources import files


def posts(n, start=1):
    return [{"title": f"T{i}", "url": f"https://b.org/p/{i}", "content_html": f"<nav>menu</nav><p>post {i} <img src='/i{i}.png'></p>", "slug": f"t{i}", "published_at": "2020-01-02", "tags": ["x"], "post_index": i} for i in range(start, start + n)]


@pytest.fixture
def said(spark, tmp_path, capsys):
    def call(*words):
        code = cli.run(spark, cli.parser().parse_args([str(w) for w in words]))
        out = capsys.readouterr()
        return code, out.out.strip(), out.err.strip()

    return call


def test_from_posts_to_letters(spark, tmp_path, said):
    (tmp_path / "posts.json").write_text(json.dumps(posts(2)))
    (tmp_path / "more.json").write_text(json.dumps(posts(3)))
    store = ("--store", tmp_path / "store")
    assert said("clean", tmp_path / "posts.json", tmp_path / "clean", "--base-url", "https://b.org")[0] == 0
    cleaned = files.large_array(spark, str(tmp_path / "clean/posts"), "title string, content_html string, content_text string, word_count int, post_index int").orderBy("post_index").collect()
    assert [(r["title"], r["content_html"], r["content_text"]) for r in cleaned] == [(f"T{i}", f'<p>post {i} <img src="https://b.org/i{i}.png"></p>', f"post {i}") for i in (1, 2)]
    assert (tmp_path / "clean/pictures").exists()
    blog = ("--slug", "b", "--name", "Blog", "--url", "https://b.org")
    assert said("upload", tmp_path / "posts.json", *store, *blog, "--dry-run")[1] == "would upload 2 posts to b"
    assert said("check", *store)[1] == "0 due"
    assert said("upload", tmp_path / "posts.json", *store, *blog)[1] == "uploaded 2 posts to b"
    assert said("subscribe", *store, "--email", "A@x.org", "--blog", "none") == (1, "", "no blog none")
    for email in ("A@x.org", "b@x.org"):
        assert said("subscribe", *store, "--email", email, "--blog", "b", "--frequency", 1, "--as-of", "2024-01-01 00:00:00")[0] == 0
    now = ("--as-of", "2024-01-01 08:00:00")
    assert said("check", *store, *now, "--verbose")[1].splitlines() == ["2 due", "  a@x.org: Blog (1/2)", "  b@x.org: Blog (1/2)"]
    assert said("send", *store, *now, "--dry-run", "--limit", 1)[1] == "would send 1"
    assert said("send", *store, *now)[0] == 2
    assert said("send", *store, *now, "--letters", tmp_path / "l1", "--limit", 1)[1] == "sent 1"
    assert said("send", *store, *now, "--letters", tmp_path / "l2")[1] == "sent 1"
    assert said("send", *store, *now, "--letters", tmp_path / "l3")[1] == "sent 0"  # not due again
    assert said("send", *store, *now, "--letters", tmp_path / "l2")[1] == "sent 1"  # a run that is repeated: its letters stand
    assert {r["current_post_index"] for r in commands.Store(spark, str(tmp_path / "store")).read("subscriptions").collect()} == {1}
    letter = spark.read.json(str(tmp_path / "l2")).first()
    assert "Post 1 of 2" in letter["html"] and "utm_source=reader" in letter["html"]
    assert said("send", *store, "--as-of", "2024-01-03 08:00:00", "--letters", tmp_path / "l4")[1] == "sent 2"
    s = commands.Store(spark, str(tmp_path / "store"))
    assert {(r["current_post_index"], r["is_completed"]) for r in s.read("subscriptions").collect()} == {(2, True)}
    assert s.rows("email_log") == 4 and s.rows("subscribers") == 2
    assert said("upload", tmp_path / "more.json", *store, *blog)[1] == "uploaded 3 posts to b"
    assert [(r["slug"], r["post_count"], r["is_active"]) for r in s.__class__(spark, str(tmp_path / "store")).read("blogs").collect()] == [("b", 3, True)]


def test_what_messages_tell_goes_into_the_log(spark, tmp_path):
    s = commands.Store(spark, str(tmp_path / "store"), buckets=4)
    blogs = spark.createDataFrame([("b", "Blog", "u"), ("c", "Other", "v")], "slug string, name string, url string")
    rows = spark.createDataFrame([(b, i, f"t{i}", f"u{i}", "<p>x", "2020-01-01", ["x"]) for b in "bc" for i in (1, 2)], "blog string, post_index int, title string, url string, content_html string, published_at string, tags array<string>")
    as_of = F.lit("2024-01-01").cast("timestamp")
    commands.upload(s, blogs, rows, as_of)
    commands.subscribe(s, spark.createDataFrame([("x@x.org", "b", 7), ("x@x.org", "c", 7), ("X@x.org", "b", 7)], "email string, blog string, frequency_days int"), as_of)
    assert s.rows("subscriptions") == 2
    assert commands.send(s, str(tmp_path / "letters"), as_of, "https://a", "src") == 2
    ids = [r[0] for r in s.read("email_log").orderBy("resend_message_id").select("resend_message_id").collect()]
    events = spark.createDataFrame([(ids[0], "email.opened", "2024-01-02"), (ids[0], "email.opened", "2024-01-03"), (ids[0], "email.clicked", "2024-01-04"), ("none", "email.opened", "2024-01-02")], "message_id string, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    commands.apply_events(s, events)
    commands.apply_events(s, events.withColumn("ts", F.to_timestamp(F.lit("2023-01-01"))))
    got = {r["resend_message_id"]: (str(r["opened_at"])[:10], str(r["clicked_at"])[:10]) for r in s.read("email_log").collect()}
    assert got == {ids[0]: ("2024-01-02", "2024-01-04"), ids[1]: ("None", "None")}
    assert s.read("email_log").filter("post_id is null or sent_at is null").count() == 0


def test_scraped_lists(spark, tmp_path, said):
    (tmp_path / "links.json").write_text(json.dumps([{"title": "Given", "url": "u1", "author": "An Author"}, {"title": "Gone", "url": "u2"}]))
    spark.createDataFrame([("u1", "<main><p>" + "word " * 40 + "</main>")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    assert said("scrape-curated", tmp_path / "links.json", tmp_path / "pages", tmp_path / "out")[1].startswith("1 posts")
    spark.createDataFrame([("/b/the-book/", "<a href=/b/one>One</a>")], "book string, html string").write.parquet(str(tmp_path / "index"))
    spark.createDataFrame([("https://h.org/b/one", "<h1>One</h1><main><p>" + "word " * 40 + "</main>")], "url string, html string").write.parquet(str(tmp_path / "chapters"))
    assert said("scrape-book", tmp_path / "index", tmp_path / "chapters", tmp_path / "book", "--prefix", "/b/", "--base-url", "https://h.org")[1].startswith("1 chapters")
