"""Queries of pages that readers see, for all blogs and feeds at once, and of what they may do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim import commands
from seriatim.operators import catalogue, checks
from seriatim.plans.binding import ROWS_OF_A_BLOG, Tables, sql
from seriatim.plans.registry import query
from seriatim.plans.scalar import WORDS
from seriatim.sources import files


@query(sql("posts feeds", """SELECT f.id AS feed_id, CAST(p.place AS INTEGER) AS place, p.id AS post_id, p.n AS n_posts FROM feeds f JOIN (
  SELECT blog_id, tag, id, row_number() OVER (PARTITION BY blog_id, tag ORDER BY post_index) AS place, count(*) OVER (PARTITION BY blog_id, tag) AS n FROM posts
  UNION ALL SELECT blog_id, NULL, id, post_index, count(*) OVER (PARTITION BY blog_id) FROM posts) p ON p.blog_id = f.blog_id AND p.tag IS NOT DISTINCT FROM f.tag_filter WHERE p.place <= 50"""))
def c03_feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed's page: its first fifty posts in order, and how many it has."""
    t = Tables(spark, sf_dir)
    return catalogue.feed_lists(t.feeds, t.posts, F.floor(F.col("post_index") / ROWS_OF_A_BLOG))


@query(sql("blogs posts", """SELECT b.slug, p.post_index, p.title, t.tags, coalesce(b.author, '') AS author FROM blogs b JOIN posts p ON p.blog_id = b.id
  JOIN (SELECT blog_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM posts GROUP BY blog_id) t ON t.blog_id = b.id"""))
def c03_blog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every blog's page: its posts with their places, and all its tags."""
    t = Tables(spark, sf_dir)
    blogs = t.blogs.join(catalogue.blog_tags(t.posts).withColumnRenamed("blog_id", "id"), "id")
    d = t.posts.select("blog_id", "post_index", "title").join(F.broadcast(blogs) if t.blog_rows <= 200_000 else blogs, F.col("blog_id") == F.col("id"))
    return d.select("slug", "post_index", "title", F.array_join("tags", ",").alias("tags"), F.coalesce("author", F.lit("")).alias("author"))


@query(sql("blogs posts feeds", """SELECT b.slug AS blog, f.slug AS feed, CAST(row_number() OVER (PARTITION BY b.slug ORDER BY f.name, f.slug) AS INTEGER) AS place, coalesce(CASE WHEN f.tag_filter IS NULL THEN b.post_count ELSE c.n END, 0) AS n_posts
  FROM feeds f JOIN blogs b ON b.id = f.blog_id LEFT JOIN (SELECT blog_id, tag, count(*) AS n FROM posts GROUP BY ALL) c ON c.blog_id = f.blog_id AND c.tag = f.tag_filter WHERE f.is_active"""))
def c03_embed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every blog's form: its active feeds by name with their counts; blogs without one have none."""
    t = Tables(spark, sf_dir)
    d = catalogue.feed_counts(t.feeds.filter("is_active"), t.blogs, t.posts)
    d = d.join(t.blogs.select(F.col("id").alias("blog_id"), F.col("slug").alias("blog")), "blog_id")
    return catalogue.numbered(d, ["blog"], [F.asc("name"), F.asc("slug")], "place").select("blog", F.col("slug").alias("feed"), "place", "n_posts")


@query("""SELECT t.theme, t.position, count(*) AS n FROM documents JOIN (VALUES ('English', 0, 'en'), ('Romance', 1, 'fr'), ('Romance', 1, 'es'), ('Continental', 2, 'de'), ('Continental', 2, 'fr'), ('Continental', 2, 'es')) AS t(theme, position, path) ON t.path = lang GROUP BY ALL""")
def src14_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal map of themes to paths, in its order, joined to the documents of each path."""
    themes = files.theme_map(spark, {"English": ["en"], "Romance": ["fr", "es"], "Continental": ["de", "fr", "es"]})
    d = themes.select("position", "theme", F.explode("paths").alias("lang"))
    return Tables(spark, sf_dir).documents.join(F.broadcast(d), "lang").groupBy("theme", "position").agg(F.count("*").alias("n"))


@query(sql("blogs posts", "SELECT p.id, b.name FROM posts p JOIN blogs b ON b.id = p.blog_id WHERE b.slug = (SELECT min(slug) FROM blogs)"))
def t11_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one blog of a slug (the first of all), then its posts."""
    t = Tables(spark, sf_dir)
    slug = catalogue.single(t.blogs.agg(F.min("slug").alias("slug")))["slug"]
    blog = catalogue.single(t.blogs.filter(F.col("slug") == slug))
    return t.posts.filter(F.col("blog_id") == blog["id"]).select("id", F.lit(blog["name"]).alias("name"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN FALSE ELSE user_id IS NOT NULL END AS allowed FROM events")
def r04_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, one in four by nobody: who may add a request by hand."""
    user = F.when(F.col("event_id") % 4 != 0, F.col("user_id"))
    return Tables(spark, sf_dir).table("events").select("event_id", checks.may_insert_request(user).alias("allowed"))


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT doc_id AS post_index, lang AS title, '<p>' || {_ESCAPED} || '</p>' AS content_html, regexp_replace(text, '^[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g') AS content_text, CAST({WORDS.format('text')} AS INTEGER) AS word_count FROM documents""")
def prj03_merged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as they were, with what cleaning finds in place of the same fields and beside the others."""
    d = Tables(spark, sf_dir).documents
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    posts = d.select(F.col("doc_id").alias("post_index"), F.col("lang").alias("title"), F.concat(F.lit("<nav>x</nav><p class=k>"), text).alias("content_html"))
    return commands.clean(posts, "https://b.org").select("post_index", "title", "content_html", "content_text", "word_count")
