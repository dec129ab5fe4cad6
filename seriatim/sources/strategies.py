"""Posts of sites by the first of several strategies that gives any, chosen for every site on its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.functions import dates, html, text, urls
from seriatim.operators import merge
from seriatim.sources import files, outcomes

POST = ("site", "title", "url", "content_html", "slug", "published_at", "tags")
LEAST_LENGTH = 100


def first_by_site(strategies: dict[str, DataFrame], folder: str, site: str = "site") -> DataFrame:
    """The rows of each site's first strategy (by the dictionary's order) that has any for it, with the strategy's name.

    All strategies' rows are written to ``folder`` once, each in a part of its own, so that choosing reads a site column
    only, and a strategy runs once.  The strategies' rows have the same columns.
    """
    spark = next(iter(strategies.values())).sparkSession
    for place, (name, rows) in enumerate(strategies.items()):
        rows.withColumn("strategy", F.lit(name)).write.parquet(f"{folder}/place={place}")
    found = spark.read.parquet(folder)
    first = found.groupBy(site).agg(F.min("place").alias("place"))
    return found.join(first, [site, "place"]).drop("place")


def first_archive_links(archives: DataFrame, found: str = "facts") -> DataFrame:
    """site, url: links that look like posts of each site's first archive page (by ``position``) that has any; ``archives``: site, url (of the page), position and facts."""
    d = archives.select("site", "position", F.col("url").alias("page"), F.explode(f"{found}.links").alias("l"))
    d = d.select("site", "position", urls.join(F.col("page"), F.col("l.href")).alias("url"))
    d = d.filter((urls.authority(F.col("url")) == urls.authority(F.col("site"))) & urls.is_archive_link(F.col("url"))).distinct()
    first = d.groupBy("site").agg(F.min("position").alias("position"))
    return d.join(first, ["site", "position"]).select("site", "url")


def captures(answers: DataFrame, body: str = "body", limit: int = 500) -> DataFrame:
    """site, url of the pages in answers (site, body) of a web archive's index: the first row names columns; at most ``limit`` rows an answer."""
    d = answers.select("site", F.posexplode(F.from_json(body, "array<array<string>>")).alias("pos", "r")).filter((F.col("pos") > 0) & (F.col("pos") <= limit))
    return d.select("site", F.col("r")[1].alias("url")).distinct()


def article_posts(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """Posts of listed pages (site, url) that are there and have a title and enough content."""
    d = html.facts(outcomes.good(outcomes.fetched(listed.select("site", "url").distinct(), pages)), "html")
    title = html.title_of(F.col("facts"))
    return d.filter(title.isNotNull() & (F.length("facts.main") >= LEAST_LENGTH)).select("site", title.alias("title"), "url", F.col("facts.main").alias("content_html"), text.slugify(title).alias("slug"), dates.parse_date(html.published(F.col("facts"))).alias("published_at"), F.array().cast("array<string>").alias("tags"))


@dataclass(frozen=True)
class Recorded:
    """What was fetched of some sites (each named by its URL), one row a page or answer."""

    archives: DataFrame  # site, position, url, html
    sitemaps: DataFrame  # site, url, xml
    answers: DataFrame  # site, body
    captures: DataFrame  # site, body
    pages: DataFrame  # url, html and maybe status


def _posts_only(listed: DataFrame) -> DataFrame:
    return listed.filter(urls.is_post(F.col("url"), F.col("site")))


def extracted(recorded: Recorded, folder: str, least: int = 5) -> DataFrame:
    """Posts of every site, of its first strategy that has any: structured archive, sitemap, REST answers, archive page, web archive.

    What can't be read counts for nothing.  The columns are ``POST`` and strategy.
    """
    archives = html.facts(recorded.archives, "html")
    listed = files.archive_articles(archives, F.col("url"), least, keep=["site"])
    structured = files.archive_posts(listed, recorded.pages, keep=["site"])
    mapped = outcomes.good(outcomes.sitemaps(recorded.sitemaps)).select("site", F.explode("pages").alias("url"))
    rest = files.rest_posts(recorded.answers, keep=["site"]).filter((F.col("title") != "") & (F.col("content_html") != ""))
    strategies = {
        "structured archive": structured,
        "sitemap": article_posts(_posts_only(mapped), recorded.pages),
        "REST": rest,
        "archive page": article_posts(_posts_only(first_archive_links(archives)), recorded.pages),
        "web archive": article_posts(_posts_only(captures(recorded.captures)), recorded.pages),
    }
    return first_by_site({k: d.select(*POST) for k, d in strategies.items()}, folder)


def titled(name: Column) -> Column:
    """A title case of words set apart by ``-``: each word's first letter is a capital, the rest small."""
    return F.array_join(F.transform(F.split(name, "-"), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), " ")


def book_chapters(indexes: DataFrame, pages: DataFrame, prefix: str, base: str, chrome: tuple[str, ...] = ()) -> DataFrame:
    """Posts of books, from their index pages (book: its URL path; html) to their chapters (pages: url, html), in the order of the index.

    A chapter's title is its h1 (unless that is one of ``chrome``, in small letters), h2 or title up to a bar; one that is
    missing, starts with ``1.`` or has over 100 characters gives way to the link's.  The date comes from metas or the
    text, the tag from the book's path.  Chapters that aren't there or too short are left out, and others keep their place.
    """
    links = files.chapter_links(html.facts(indexes, "html"), prefix, group="book").filter(F.col("title") != "")
    links = links.select("book", "pos", F.col("title").alias("given"), F.concat(F.lit(base), "href").alias("url"))
    d = html.facts(outcomes.good(outcomes.fetched(links, pages)), "html")
    f = F.col("facts")
    h1 = html.heading(f, "h1")
    own = F.coalesce(F.when(~F.lower(h1).isin(*chrome), h1) if chrome else h1, html.heading(f, "h2"), F.nullif(F.trim(F.split_part(f["title"], F.lit("|"), F.lit(1))), F.lit("")))
    title = F.when(own.startswith("1.") | (F.length(own) > 100), F.col("given")).otherwise(own)
    plain = html.entity_text(F.col("html"))
    date = F.coalesce(dates.parse_date(html.published(f, times_first=False, metas=("article:published_time", "datepublished", "date"))), dates.month_date(plain))
    last = F.element_at(F.filter(F.split("book", "/"), lambda x: x != ""), -1)
    tag = text.slugify(titled(last))
    d = d.filter(own.isNotNull() & (F.length(f["main"]) >= LEAST_LENGTH))
    return d.select("book", F.col("pos").alias("chapter_order"), title.alias("title"), "url", f["main"].alias("content_html"), urls.slug_of(F.col("url")).alias("slug"), date.alias("published_at"), F.array(tag).alias("tags"))
