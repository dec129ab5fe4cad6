"""File sources and sinks: JSON posts and links, sitemaps, REST and archive-index answers, books, and text pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriatim import schemas
from seriatim.functions import dates, html, text, urls
from seriatim.operators import catalogue, merge
from seriatim.sources import outcomes


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array; keys it lacks are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def posts_file(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    return (large_array if large else json_array)(spark, path, schemas.POST_FILE).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def links_file(spark: SparkSession, path: str) -> DataFrame:
    """Curated links with ``pos``, their order in the file (which one task reads)."""
    return json_array(spark, path, schemas.CURATED_LINK).withColumn("pos", F.monotonically_increasing_id())


def write_json_array(rows: DataFrame, path: str, order: list[Column], group: str) -> None:
    """A file with one JSON array for each ``group``, in a folder of its own; ``order`` is unique in a group.

    Each item is a line of the file, so a group's rows pass through a task one by one and are never one value.
    """
    w = Window.partitionBy(group).orderBy(*order)
    item = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != group]))
    line = F.concat(F.when(F.row_number().over(w) == 1, "[").otherwise(""), item, F.when(F.lead(F.lit(1)).over(w).isNull(), "]").otherwise(","))
    rows.select(group, line.alias("value")).write.partitionBy(group).text(path)


def write_large_array(rows: DataFrame, path: str, order: list[Column], group: str, bucket: Column) -> None:
    """One JSON array for each ``group``, in parts that many tasks write: the parts of a group's folder, by name and end to end, are the array.

    Rows get their places (``bucket`` as for ``catalogue.numbered``) and go to the writers by ranges of them, an item a
    line; the first item of a group opens the array and the last one closes it.  All parts are committed together.
    """
    place, total = merge.unused("place", rows), merge.unused("total", rows)
    d = catalogue.numbered(rows, [group], order, place, bucket)
    counts = rows.groupBy(F.col(group).alias(f"{total}_")).agg(F.count("*").alias(total))
    d = d.join(counts, F.col(group).eqNullSafe(F.col(f"{total}_")))
    item = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != group]))
    line = F.concat(F.when(F.col(place) == 1, "[").otherwise(""), item, F.when(F.col(place) == F.col(total), "]").otherwise(","))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.select(group, F.col(place), line.alias("value")).repartitionByRange(n, group, place).sortWithinPartitions(group, place)
    d.select(group, "value").write.partitionBy(group).text(path)


def large_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of what ``write_large_array`` has written, each line by whichever task; keys that an item lacks are null."""
    d = spark.read.text(path)
    item = F.from_json(F.regexp_replace("value", r"^\[|[,\]]$", ""), schema)
    return d.withColumn("value", item).select("value.*", *(c for c in d.columns if c != "value"))


def write_images(cleaned: DataFrame, path: str) -> bool:
    """Images of all posts as JSON lines; nothing stays written if there are none.  The posts are cleaned once."""
    spark = cleaned.sparkSession
    cleaned.select(F.explode("cleaned.images").alias("i")).select("i.src", "i.alt").write.json(path)
    if not spark.read.text(path).isEmpty():
        return True
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return False


def sitemap(read: Callable[[DataFrame], DataFrame], first: DataFrame, folder: str, most: int = 50) -> DataFrame:
    """level, url (of the map), pages, maps and failed of all sitemaps below ``first`` (url).

    ``read`` turns URLs into sitemaps (url, xml).  Indexes are followed to their end, each map once.  A level's maps are
    read and parsed once, into a part of ``folder``; what comes next is told from the URLs of the levels before, so the
    plan of a level is as small as the first one's.  More than ``most`` levels are an error, not a shorter result.
    """
    spark = first.sparkSession
    todo = first.select("url").distinct()
    for level in range(most):
        todo.write.parquet(f"{folder}/urls/level={level}")
        todo = spark.read.schema("url string").parquet(f"{folder}/urls/level={level}")
        if todo.isEmpty():
            return spark.read.parquet(f"{folder}/maps")
        outcomes.sitemaps(read(todo).select("url", "xml")).write.parquet(f"{folder}/maps/level={level}")
        listed = spark.read.schema("maps array<string>").parquet(f"{folder}/maps/level={level}").select(F.explode("maps").alias("url")).distinct()
        todo = listed.join(spark.read.schema("url string").parquet(f"{folder}/urls"), "url", "left_anti")
    raise ValueError(f"sitemaps nest over {most} levels or more")


def sitemap_pages(maps: DataFrame) -> DataFrame:
    """Page URLs of sitemaps."""
    return maps.select(F.explode("pages").alias("url"))


def rest_posts(answers: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Posts of REST answers (JSON arrays of items), with empty texts for what an item lacks; titles lose tags and entities.  Answers that are no such arrays give none."""
    kept = keep or []
    d = outcomes.good(outcomes.answers(answers.select(*kept, body), body)).select(*kept, F.explode("items").alias("i"))
    return d.select(*kept, html.entity_text(F.coalesce("i.title.rendered", F.lit(""))).alias("title"), F.coalesce("i.link", F.lit("")).alias("url"), F.coalesce("i.content.rendered", F.lit("")).alias("content_html"), F.coalesce("i.slug", F.lit("")).alias("slug"), dates.parse_date(F.col("i.date")).alias("published_at"), F.array().cast("array<string>").alias("tags"))


def archive_index(answers: DataFrame, body: str = "body", limit: int | None = 500) -> DataFrame:
    """Rows of a web archive's index (an array of rows, the first one naming columns): first capture of each URL by time, then place, at most ``limit`` in that order."""
    d = answers.select(F.posexplode(F.from_json(body, "array<array<string>>")).alias("pos", "r")).filter("pos > 0")
    d = d.select("pos", F.col("r")[0].alias("timestamp"), F.col("r")[1].alias("original"), F.col("r")[2].alias("statuscode"))
    d = merge.first_by(d, ["original"], [F.asc("timestamp"), F.asc("pos")])
    return d.orderBy("timestamp", "pos", "original").limit(limit) if limit else d


def archive_links(facts: DataFrame, site: Column, found: str = "facts") -> DataFrame:
    """Distinct links of archive pages that look like posts."""
    d = facts.select(F.explode(f"{found}.links").alias("l"), site.alias("site"))
    d = d.select(urls.join(F.col("site"), F.col("l.href")).alias("url"), "site").filter(F.col("url").isNotNull())
    return d.filter((urls.authority(F.col("url")) == urls.authority(F.col("site"))) & urls.is_archive_link(F.col("url"))).select("url").distinct()


def first_with_rows(parts: list[Callable[[], DataFrame]]) -> DataFrame | None:
    """The rows of the first of several strategies that gives any.

    A strategy whose input isn't there or has another shape (an AnalysisException) counts as empty; a job that fails
    while it runs is an error.
    """
    for strategy in parts:
        try:
            d = strategy()
            if not d.isEmpty():
                return d
        except AnalysisException:
            continue
    return None


def archive_articles(facts: DataFrame, site: Column, least: int = 5, found: str = "facts", keep: list[str] | None = None) -> DataFrame:
    """title, url, tags, date of the posts that structured archives (pages of at least ``least`` articles) list; articles without a linked title are left out."""
    d = facts.filter(F.size(f"{found}.articles") >= least).select(*(keep or []), F.explode(f"{found}.articles").alias("a"), site.alias("_page"))
    return d.filter(F.col("a.href").isNotNull()).select(*(keep or []), F.col("a.title").alias("title"), urls.join(F.col("_page"), F.col("a.href")).alias("url"), F.col("a.tags").alias("tags"), F.col("a.date").alias("date"))


def archive_posts(listed: DataFrame, pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Posts of archive entries (title, url, tags, date) whose pages (url, html) are there: the page's own title and date come first, tags are the archive's."""
    d = listed.join(html.facts(pages.select("url", "html"), "html").select("url", "facts"), "url")
    slug = F.regexp_extract(urls.path(F.col("url")), "([^/]+)/*$", 1)
    title = F.coalesce(html.title_of(F.col("facts")), F.col("title"))
    date = F.coalesce(dates.parse_date(html.published(F.col("facts"))), dates.parse_date(F.col("date")))
    return d.select(*(keep or []), title.alias("title"), "url", F.col("facts.main").alias("content_html"), F.when(slug != "", slug).otherwise(text.slugify(title)).alias("slug"), date.alias("published_at"), "tags")


def numbered_urls(numbers: DataFrame, pattern: str) -> DataFrame:
    """number and url of numbered pages."""
    return numbers.select("number", F.format_string(pattern, "number").alias("url"))


def chapter_links(facts: DataFrame, prefix: str, found: str = "facts", group: str | None = None) -> DataFrame:
    """Links of a book's index that stand two levels deep under ``prefix``, each once (in a ``group``), with their place; way-back links are left out."""
    kept = [group] if group else []
    d = facts.select(*kept, F.posexplode(f"{found}.links").alias("pos", "l")).select(*kept, "pos", F.col("l.href").alias("href"), F.col("l.text").alias("title"))
    d = d.filter(F.col("href").startswith(prefix) & (F.length("href") - F.length(F.replace("href", F.lit("/"), F.lit(""))) == 2) & ~F.col("title").startswith("←"))
    return merge.first_by(d, [*kept, "href"], [F.asc("pos")])


def theme_map(spark: SparkSession, themes: dict[str, list[str]]) -> DataFrame:
    """position, theme, paths of a literal map, in its order."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(themes.items())], "position int, theme string, paths array<string>")


def themed_posts(pages: DataFrame, inverted: DataFrame, base: str, metas: tuple[str, ...] = html.DATE_METAS, times_first: bool = True, mark: str = "·") -> DataFrame:
    """Posts of pages (path, html) that themes list, with their themes as tags; short ones are left out."""
    d = html.facts(pages, "html").join(inverted, "path")
    title = F.coalesce(F.nullif(F.try_element_at("facts.ids", F.lit("title")), F.lit("")), html.heading(F.col("facts"), "h1"), text.title_part(F.col("facts.title"), mark))
    return d.filter(F.length("facts.main") >= 100).select(title.alias("title"), F.concat(F.lit(base), "path").alias("url"), F.col("facts.main").alias("content_html"), urls.path_slug(F.col("path")).alias("slug"), dates.parse_date(html.published(F.col("facts"), times_first, metas)).alias("published_at"), F.col("themes").alias("tags"))


def curated_posts(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Posts of a curated list (pos, title, url, author) in its order: the given title unless a heading is short enough, the author as tag."""
    d = links.join(html.facts(pages, "html").select("url", "facts"), "url")
    own = html.heading(F.col("facts"), "h1")
    title = F.when(F.length(own) < 200, own).otherwise(F.col("title"))
    tags = F.when(F.col("author").isNotNull(), F.array(text.slugify(F.col("author")))).otherwise(F.array().cast("array<string>"))
    return d.filter(F.length("facts.main") >= 100).select("pos", title.alias("title"), "url", F.col("facts.main").alias("content_html"), text.slugify(title).alias("slug"), dates.parse_date(html.published(F.col("facts"))).alias("published_at"), tags.alias("tags"))


def chapters(zipped: DataFrame, member: str = outcomes.CHAPTER) -> DataFrame:
    """book, number, name, html of the chapters of zipped books (path, content) that can be read."""
    return outcomes.good(outcomes.chapters(zipped, member))


def books(spark: SparkSession, path: str, member: str = outcomes.CHAPTER) -> DataFrame:
    return chapters(spark.read.format("binaryFile").load(path), member)


def book_posts(chapters: DataFrame, base: str) -> DataFrame:
    """Posts of chapters with a title; the slug comes from the file's name, the date from the last one in the text."""
    d = html.clean(html.facts(chapters, "html"), "html", F.lit(base))
    name = F.element_at(F.split("name", "/"), -1)
    slug = F.replace(F.regexp_replace(name, r"^chapter-\d+-(?:slug-\d+-)?", ""), F.lit(".html"), F.lit(""))
    title = html.heading(F.col("facts"), "h2")
    date = F.coalesce(dates.last_date(F.replace("cleaned.text", F.lit("\n"), F.lit(" "))), F.concat(F.lit("2026-01-"), F.lpad(F.col("number").cast("string"), 2, "0"), F.lit("T00:00:00")))
    return d.filter(title.isNotNull() & (F.col("cleaned.text") != "")).select(F.col("number").alias("post_index"), title.alias("title"), slug.alias("slug"), F.concat(F.lit(f"{base}/"), slug, F.lit("/")).alias("url"), date.alias("published_at"), F.col("cleaned.html").alias("content_html"), F.col("cleaned.text").alias("content_text"), F.col("cleaned.excerpt").alias("excerpt"), F.col("cleaned.word_count").alias("word_count"))


def numbered_papers(pages: DataFrame, chrome: list[str], authors: list[str], markers: list[str], publications: list[str]) -> DataFrame:
    """number, title, author, published and body of paper pages (number, html)."""
    d = html.facts(pages, "html")
    clean = F.transform(F.filter("facts.headings", lambda h: h["tag"] != "h6"), lambda h: text.normalize_space(h["text"]))

    def content(t: Column) -> Column:
        bad = t == ""
        for c in chrome:
            bad = bad | t.contains(c)
        return ~bad & text.byline(t, authors).isNull()

    head = F.try_element_at(F.filter(clean, content), F.lit(1))
    lines = F.filter(F.transform(F.filter("facts.headings", lambda h: h["tag"].isin("h3", "h4", "h5")), lambda h: text.byline(text.normalize_space(h["text"]), authors)), lambda x: x.isNotNull())
    subject = F.coalesce(text.subject_cut(head, markers, publications), F.lit(""))
    return d.select("number", F.concat(F.lit("No. "), F.col("number").cast("string"), F.when(subject != "", F.concat(F.lit(": "), subject)).otherwise("")).alias("title"), F.try_element_at(lines, F.lit(1)).alias("author"), dates.first_date(head).alias("published"), F.array_join("facts.paragraphs", "\n").alias("body"))


def lecture_posts(lectures: DataFrame, tag: str, fixes: dict[str, str] | None = None) -> DataFrame:
    """Posts of lectures (pos, title, url, date, raw text)."""
    t = text.clean_scan(F.col("raw"), fixes)
    d = lectures.withColumn("content_text", t).withColumn("word_count", text.word_count(F.col("content_text")))
    return d.select("title", "url", text.slugify(F.col("title")).alias("slug"), text.paragraphs_html(F.col("content_text")).alias("content_html"), "content_text", text.excerpt_words(F.col("content_text")).alias("excerpt"), F.concat("date", F.lit("T00:00:00")).alias("published_at"), F.col("pos").alias("post_index"), "word_count", text.reading_minutes_floor(F.col("word_count")).alias("reading_time_minutes"), F.array(F.lit(tag)).alias("tags"))


def page_range(chapters: DataFrame, pages: DataFrame, offset: int = 0) -> DataFrame:
    """Text of chapters (chapter, first, last) from a book's pages (page, text), with ``offset`` pages before the first."""
    d = chapters.select("chapter", F.explode(F.sequence("first", "last")).alias("p")).withColumn("page", F.col("p") + offset)
    joined = d.join(pages, "page").groupBy("chapter").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("s"))
    return joined.select("chapter", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("text"))


#: How many characters of a heading must stand in the text, the longest first; None is the whole.
HEADING_PREFIXES = (None, 35, 20)
_PLAIN = str.maketrans({"’": "'", "—": "-", "–": "-"})


def split_sections(content: str, headings: list[str]) -> list[tuple[str, str]]:
    """Headings found one after the other at starts of lines, each with the text between its line and the next heading.

    Both sides are compared in lower case, with one kind of quote and dash.  A heading counts as found where its longest
    possible prefix stands first after the one before; one that is missing is left out.
    """
    starts = [m.end() for m in re.finditer(r"(?:^|\n)\s*", content)]
    plain = content.translate(_PLAIN).lower()
    if len(plain) != len(content):  # a letter that grows in lower case; keep places
        plain = "".join(c if len(c.lower()) != 1 else c.lower() for c in content.translate(_PLAIN))
    found: list[tuple[int, int, str]] = []  # number of the line start, place, heading
    line = 0
    for heading in headings:
        wanted = heading.translate(_PLAIN).lower()
        at = next((i for n in HEADING_PREFIXES for i in range(line, len(starts)) if plain.startswith(wanted[:n], starts[i])), None)
        if at is not None:
            found.append((at, starts[at], heading))
            line = at + 1
    ends = [place for _, place, _ in found[1:]] + [len(content)]
    out = []
    for (_, place, heading), end in zip(found, ends, strict=True):
        feed = content.find("\n", place)
        body = place + len(heading) if feed < 0 else feed + 1
        out.append((heading, content[body:end].strip()))
    return out


def sections(chapters: DataFrame) -> DataFrame:
    """chapter, nth, heading, content from chapters (chapter, text, headings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in html.parts(batches):
            rows = [(c, i, h, s) for c, t, hs in zip(*(batch.column(k).to_pylist() for k in ("chapter", "text", "headings")), strict=True) for i, (h, s) in enumerate(split_sections(t or "", hs or []), 1)]
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("chapter", "nth", "heading", "content"))}, schema=pa.schema([("chapter", pa.string()), ("nth", pa.int32()), ("heading", pa.string()), ("content", pa.string())]))

    return chapters.select("chapter", "text", "headings").mapInArrow(run, "chapter string, nth int, heading string, content string")


def section_posts(found: DataFrame, names: dict[str, str], intro: str = "intro") -> DataFrame:
    """Posts of sections (chapter, short_title, nth, heading, content); sections without paragraphs are left out."""
    d = found.withColumn("p", text.paragraphs(F.col("content"))).filter(F.size("p") > 0)
    d = d.withColumn("content_text", F.array_join("p", "\n\n")).withColumn("shown", text.display_name(F.col("heading"), names))
    first = F.col("chapter") == intro
    title = F.when(first, F.concat(F.lit("Introduction — "), "shown")).otherwise(F.concat(F.lit("Ch "), F.replace("chapter", F.lit("ch"), F.lit("")), F.lit(": "), "short_title", F.lit(" — "), "shown"))
    words = text.word_count(F.col("content_text"))
    return d.select("chapter", "nth", title.alias("title"), text.section_slug(F.when(first, "introduction").otherwise(F.col("chapter")), F.col("shown")).alias("slug"), F.array_join(F.transform("p", lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "").alias("content_html"), "content_text", text.excerpt_short(F.col("content_text")).alias("excerpt"), words.alias("word_count"), text.reading_minutes(words).alias("reading_time_minutes"))
