"""Broken records, sitemaps that nest, and strategies chosen by site."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from seriatim.sources import files, outcomes, paged, strategies


def zipped(members, **options):
    with zipfile.ZipFile(data := io.BytesIO(), "w", **options) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return data.getvalue()


def test_broken_books_cost_themselves(spark):
    whole = zipped({"OEBPS/chapter-1-a.html": "one", "OEBPS/chapter-2-b.html": b"\xff", "OEBPS/chapter-3-c.html": "three", "OEBPS/toc.html": "x"})
    packed = bytearray(zipped({"OEBPS/chapter-1-a.html": "long " * 500}, compression=zipfile.ZIP_DEFLATED))
    packed[60] ^= 255
    wrong = bytearray(zipped({"OEBPS/chapter-1-a.html": "one", "OEBPS/chapter-2-b.html": "two"}))
    wrong[wrong.find(b"one")] ^= 1
    locked = bytearray(zipped({"OEBPS/chapter-1-a.html": "one"}))
    locked[locked.find(b"PK\x01\x02") + 8] |= 1  # marked as encrypted
    locked[6] |= 1
    rows = [("whole", whole), ("cut", whole[:80]), ("packed", bytes(packed)), ("wrong", bytes(wrong)), ("locked", bytes(locked)), ("none", None), ("empty", b""), ("text", b"no zip at all"), ("bare", zipped({}))]
    d = outcomes.chapters(spark.createDataFrame(rows, "path string, content binary").repartition(2))
    assert sorted((r["book"], r["number"], r["html"]) for r in outcomes.good(d).collect()) == [("whole", 1, "one"), ("whole", 3, "three"), ("wrong", 2, "two")]
    assert sorted(tuple(r)[1:] for r in outcomes.failures(d, "book", "book").collect()) == sorted(
        [("whole", "OEBPS/chapter-2-b.html", "not UTF-8"), ("cut", None, "not a zip"), ("packed", "OEBPS/chapter-1-a.html", "broken member"), ("wrong", "OEBPS/chapter-1-a.html", "broken member"), ("locked", "OEBPS/chapter-1-a.html", "broken member"), ("none", None, "no content"), ("empty", None, "not a zip"), ("text", None, "not a zip")],
        key=lambda r: (r[0], r[1] or ""),
    )
    assert files.chapters(spark.createDataFrame(rows, "path string, content binary")).columns == ["book", "number", "name", "html"]


def test_broken_sitemaps_and_answers(spark):
    maps = [("a", "<urlset><url><loc> u1 </loc></url><url/></urlset>"), ("b", "<urlset><url><loc>u2</url></urlset>"), ("c", None), ("d", ""), ("e", "<sitemapindex><sitemap><loc>m</loc></sitemap></sitemapindex>"), ("f", "plain"), ("g", "<urlset></urlset>")]
    d = outcomes.sitemaps(spark.createDataFrame(maps, "url string, xml string"))
    assert sorted((r["url"], r["pages"], r["maps"]) for r in outcomes.good(d).collect()) == [("a", ["u1"], []), ("e", [], ["m"]), ("g", [], [])]
    assert sorted((r["path"], r["reason"]) for r in outcomes.failures(d, "sitemap", "url").collect()) == [("b", "not XML"), ("c", "no content"), ("d", "not XML"), ("f", "not XML")]
    bodies = [("a", json.dumps([{"link": "l", "title": {"rendered": "t"}}])), ("b", '[{"link": "l"'), ("c", None), ("d", '{"code": 1}'), ("e", "<html>"), ("f", "[]"), ("g", ' [{"link": 3}]')]
    d = outcomes.answers(spark.createDataFrame(bodies, "url string, body string"))
    assert sorted((r["url"], [i["link"] for i in r["items"]]) for r in outcomes.good(d).collect()) == [("a", ["l"]), ("f", []), ("g", ["3"])]
    assert sorted((r["path"], r["reason"]) for r in outcomes.failures(d, "answer", "url").collect()) == [("b", "not JSON"), ("c", "no content"), ("d", "not an array"), ("e", "not JSON")]


def test_pages_that_were_not_fetched(spark):
    listed = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "url string, pos int")
    pages = spark.createDataFrame([("a", "x", 200), ("b", "gone", 410), ("c", None, 200)], "url string, html string, status int")
    d = outcomes.fetched(listed, pages)
    assert [tuple(r) for r in outcomes.good(d).collect()] == [("a", 1, "x")]
    assert sorted((r["path"], r["reason"]) for r in outcomes.failures(d, "page", "url").collect()) == [("b", "status 410"), ("c", "no content"), ("d", "not fetched")]
    assert outcomes.good(outcomes.fetched(listed, pages.drop("status"))).count() == 2


def test_sitemaps_are_read_once_and_nest_to_a_bound(spark, tmp_path):
    index = lambda *xs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in xs) + "</sitemapindex>"
    known = {"0": index("1", "0", "1"), "1": index("2", "0", "missing"), "2": "<urlset><url><loc>p</loc></url></urlset>"}
    d = spark.createDataFrame(list(known.items()), "url string, xml string")
    read = spark.sparkContext.accumulator(0)

    def counted(urls):
        found = urls.join(d, "url")
        read.add(found.count())
        return found

    got = files.sitemap(counted, spark.createDataFrame([("0",), ("0",)], "url string"), str(tmp_path / "a"))
    assert sorted((r["level"], r["url"], r["pages"]) for r in got.collect()) == [(0, "0", []), (1, "1", []), (2, "2", ["p"])]
    assert read.value == 3
    with pytest.raises(ValueError, match="nest over 2 levels"):
        files.sitemap(lambda urls: urls.join(d, "url"), spark.createDataFrame([("0",)], "url string"), str(tmp_path / "b"), most=2)
    nothing = files.sitemap(lambda urls: urls.join(d, "url"), spark.createDataFrame([("none",)], "url string"), str(tmp_path / "c"))
    assert files.sitemap_pages(nothing).count() == 0


def test_first_strategy_of_each_site(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame(list(xs), "site string, url string")
    none = spark.createDataFrame([], "site string, url string")
    got = strategies.first_by_site({"one": rows(("a", "1"), ("a", "2")), "two": rows(("a", "3"), ("b", "4")), "three": none, "four": rows(("c", "5"), ("b", "6"))}, str(tmp_path / "s"))
    assert sorted((r["site"], r["url"], r["strategy"]) for r in got.collect()) == [("a", "1", "one"), ("a", "2", "one"), ("b", "4", "two"), ("c", "5", "four")]


def test_captures_and_titles(spark):
    body = json.dumps([["timestamp", "original", "statuscode"], ["1", "u", "200"], ["2", "u", "200"], ["3", "v", "200"]])
    d = spark.createDataFrame([("s", body), ("t", None), ("t", "broken"), ("t", "[]")], "site string, body string")
    assert sorted(map(tuple, strategies.captures(d).collect())) == [("s", "u"), ("s", "v")]
    assert [tuple(r) for r in strategies.captures(d, limit=1).collect()] == [("s", "u")]
    assert spark.range(1).select(strategies.titled(F.lit("the-quiet-rIVER-"))).first()[0] == "The Quiet River "


def recorded(folder, total, there, broken=()):
    for page in range(1, there + 1):
        (folder / f"page={page}").mkdir(parents=True)
        body = "{" if page in broken else json.dumps({"total_pages": total, "items": [{"title": {"rendered": f"t{page}-{i}"}, "link": page, "content": {"rendered": "c"}} for i in range(3)]})
        (folder / f"page={page}/part-0").write_text(body)


def pages_read(log):
    return sorted({int(p.name.split("-")[0]) for p in log.iterdir()}) if log.exists() else []


def test_paged_answers_stop_at_the_stated_total(spark, tmp_path):
    recorded(tmp_path / "in", total=7, there=12, broken=(4,))
    d = paged.paged_answers(spark, str(tmp_path / "in"), log=str(tmp_path / "log"), pages_per_task="3")
    rows = d.collect()
    assert sorted((r["page"], r["title"]) for r in rows if r["failed"] is None) == sorted((p, f"t{p}-{i}") for p in (1, 2, 3, 5, 6, 7) for i in range(3))
    assert [(r["page"], r["failed"]) for r in rows if r["failed"]] == [(4, "not an answer")]
    assert rows[0]["link"] == "1"
    assert pages_read(tmp_path / "log") == [1, 2, 3, 4, 5, 6, 7]
    assert d.rdd.getNumPartitions() == 3


def test_paged_answers_read_only_filtered_pages(spark, tmp_path):
    recorded(tmp_path / "in", total=9, there=9)
    d = paged.paged_answers(spark, f"file://{tmp_path}/in", log=f"file://{tmp_path}/log").filter("page > 5 and page in (2, 6, 7, 9) and title like '%-0'")
    assert sorted(r["page"] for r in d.collect()) == [6, 7, 9]
    assert pages_read(tmp_path / "log") == [1, 6, 7, 9]  # the first tells the total


def test_paged_answers_that_end_early_or_are_none(spark, tmp_path):
    recorded(tmp_path / "in", total=20, there=4)
    assert paged.paged_answers(spark, str(tmp_path / "in"), pages_per_task="50").count() == 12
    assert paged.paged_answers(spark, str(tmp_path / "nothing")).count() == 0
    recorded(tmp_path / "odd", total=1, there=2, broken=(1,))
    assert [(r["page"], r["failed"]) for r in paged.paged_answers(spark, str(tmp_path / "odd")).collect()] == [(1, "not an answer")]
    assert paged.ranges([5, 1, 2, 3, 9, 10], 2) == [(1, 2), (3, 3), (5, 5), (9, 10)]
    assert [r[-1] for r in paged.rows_of(1, '{"items": [3, {"title": "x"}]}')] == ["not an item", None]
    with pytest.raises(ValueError, match="hdfs"):
        paged.local("hdfs://host/x")
