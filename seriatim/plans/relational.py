"""Queries of projections, filters, joins, aggregates, positions, orders and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriatim.functions import text
from seriatim.operators import catalogue, checks, delivery, merge
from seriatim.plans.binding import AS_OF, ROWS_OF_A_BLOG, Tables, sql
from seriatim.plans.registry import query

CAMPAIGN = "reader"
DUE = f"""s.is_active AND NOT s.is_completed AND s.next_send_at <= TIMESTAMP '{AS_OF}'"""
DUE_FROM = f"""FROM subscriptions s JOIN subscribers u ON u.id = s.subscriber_id JOIN blogs b ON b.id = s.blog_id
  JOIN posts p ON p.blog_id = s.blog_id AND p.post_index = s.current_post_index + 1 WHERE {DUE} AND u.is_confirmed"""
DUE_VIEWS = "blogs posts subscribers subscriptions"


def _due(t: Tables) -> DataFrame:
    return delivery.due(t.subscriptions, t.subscribers, t.blogs, t.posts, t.as_of, t.blog_rows)


@query(sql(DUE_VIEWS, f"""SELECT s.id AS subscription_id, u.email AS subscriber_email, u.name AS subscriber_name, b.name AS blog_name, b.slug AS blog_slug, p.id AS post_id,
  p.title AS post_title, p.content_html AS post_content_html, p.original_url AS post_original_url, s.current_post_index + 1 AS post_index, b.post_count AS total_posts {DUE_FROM}"""))
def j01_due_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _due(Tables(spark, sf_dir))


@query(sql(DUE_VIEWS, f"""SELECT s.id AS subscription_id, p.id AS post_id, 'Post ' || CAST(s.current_post_index + 1 AS VARCHAR) || ' of ' || CAST(b.post_count AS VARCHAR) AS progress_text,
  CAST(CASE WHEN b.post_count > 0 THEN round_even(CAST(s.current_post_index + 1 AS DOUBLE) / b.post_count * 100, 0) ELSE 0 END AS INTEGER) AS progress_pct,
  p.original_url || CASE WHEN position('?' IN p.original_url) > 0 THEN '&' ELSE '?' END || 'utm_source={CAMPAIGN}&utm_medium=email&utm_campaign=drip' AS url {DUE_FROM}"""))
def e1_due_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: who is due, with which post and progress."""
    d = _due(Tables(spark, sf_dir))
    return d.select("subscription_id", "post_id", text.progress_text(F.col("post_index"), F.col("total_posts")).alias("progress_text"), text.progress_percent(F.col("post_index"), F.col("total_posts")).alias("progress_pct"), text.with_campaign(F.col("post_original_url"), CAMPAIGN).alias("url"))


TEMPLATE = "<h1>{{post_title}}</h1><p>{{blog_name}} | {{progress_text}} | {{progress_pct}}%</p>{{post_content}}<a href='{{post_url_utm}}'>read</a> <a href='{{unsubscribe_url}}'>stop</a> {{app_url}}"
APP = "https://reader.example.org"
_Q = "''"


REPLY = "letters@reader.example.org"


@query(sql(DUE_VIEWS, f"""SELECT s.id AS subscription_id, p.id AS post_id, s.current_post_index + 1 AS post_index, '{REPLY}' AS reply_to, '<mailto:{REPLY}?subject=unsubscribe>' AS list_unsubscribe, CASE WHEN coalesce(u.name, '') <> '' THEN u.name || ' <' || u.email || '>' ELSE u.email END AS recipient,
  p.title || ' — ' || b.name AS subject,
  '<h1>' || p.title || '</h1><p>' || b.name || ' | Post ' || CAST(s.current_post_index + 1 AS VARCHAR) || ' of ' || CAST(b.post_count AS VARCHAR) || ' | '
  || CAST(CAST(CASE WHEN b.post_count > 0 THEN round_even(CAST(s.current_post_index + 1 AS DOUBLE) / b.post_count * 100, 0) ELSE 0 END AS INTEGER) AS VARCHAR) || '%</p>' || p.content_html
  || '<a href={_Q}' || p.original_url || CASE WHEN position('?' IN p.original_url) > 0 THEN '&' ELSE '?' END || 'utm_source={CAMPAIGN}&utm_medium=email&utm_campaign=drip{_Q}>read</a> <a href={_Q}{APP}/unsubscribe?sid='
  || CAST(s.id AS VARCHAR) || '{_Q}>stop</a> {APP}' AS html {DUE_FROM}"""))
def f12_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.outbox(_due(Tables(spark, sf_dir)), TEMPLATE, APP, CAMPAIGN, reply_to=REPLY)


@query(sql(DUE_VIEWS, f"SELECT count(*) AS n_due {DUE_FROM}"))
def snk07_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _due(Tables(spark, sf_dir)).agg(F.count("*").alias("n_due"))


@query(sql(DUE_VIEWS, f"SELECT s.id AS subscription_id, p.id AS post_id {DUE_FROM} ORDER BY s.id LIMIT 10"))
def t10_due_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _due(Tables(spark, sf_dir)).select("subscription_id", "post_id").orderBy("subscription_id").limit(10)


@query(sql("posts subscriptions", f"""SELECT s.id AS subscription_id, s.blog_id, s.current_post_index + 1 AS post_index FROM subscriptions s WHERE {DUE}
  AND NOT EXISTS (SELECT 1 FROM posts p WHERE p.blog_id = s.blog_id AND p.post_index = s.current_post_index + 1)"""))
def x06_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return delivery.stalled(t.subscriptions, t.posts, t.as_of)


@query(sql("posts feeds subscriptions", f"""SELECT s.id AS subscription_id, s.feed_id, p.id AS post_id, p.tag_index FROM subscriptions s JOIN feeds f ON f.id = s.feed_id
  JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY blog_id, tag ORDER BY post_index) AS INTEGER) AS tag_index FROM posts) p ON p.blog_id = f.blog_id AND p.tag = f.tag_filter AND p.tag_index = s.current_post_index + 1 WHERE {DUE}"""))
def x05_due_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return delivery.due_by_tag(t.subscriptions, t.feeds, t.posts, t.as_of)


@query(sql("subscriptions", f"SELECT id FROM subscriptions s WHERE {DUE}"))
def p01_due_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.subscriptions.filter(F.col("is_active") & ~F.col("is_completed") & (F.col("next_send_at") <= t.as_of)).select("id")


@query(sql("blogs subscriptions", "SELECT s.id, s.frequency_days, s.current_post_index, b.post_count FROM subscriptions s JOIN blogs b ON b.id = s.blog_id"))
def j02_subscription_blog(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    b = t.blogs.select(F.col("id").alias("blog_id"), "post_count")
    return t.subscriptions.join(b, "blog_id").select("id", "frequency_days", "current_post_index", "post_count")


SERIES = [("First", "first", "en"), ("Second", "second", "fr")]
SERIES_SQL = "(VALUES ('First', 'first', 'en'), ('Second', 'second', 'fr')) AS v(name, slug, tag)"


@query(sql("blogs", f"SELECT b.id || ':' || v.slug AS id, b.id AS blog_id, v.name, v.slug, v.tag AS tag_filter FROM blogs b CROSS JOIN {SERIES_SQL} WHERE b.is_active"))
def j03_blog_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every active blog with each of a fixed list of series (an inline relation of two rows)."""
    series = spark.createDataFrame(SERIES, "name string, slug string, tag string")
    b = Tables(spark, sf_dir).blogs.filter("is_active").select(F.col("id").alias("blog_id"))
    return b.crossJoin(F.broadcast(series)).select(F.concat_ws(":", "blog_id", "slug").alias("id"), "blog_id", "name", "slug", F.col("tag").alias("tag_filter"))


@query(sql("blogs", "SELECT id || '-feed' AS id, id AS blog_id, name, id || '-feed' AS slug FROM blogs WHERE slug = 'src3'"))
def j10_feed_from_blog(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Tables(spark, sf_dir).blogs.filter(F.col("slug") == "src3")
    return b.select(F.concat("id", F.lit("-feed")).alias("id"), F.col("id").alias("blog_id"), "name", F.concat("id", F.lit("-feed")).alias("slug"))


@query(sql("blogs feeds", "SELECT f.id, b.name AS blog_name, b.url AS blog_url FROM feeds f LEFT JOIN blogs b ON b.id = f.blog_id AND b.is_active"))
def j04_feed_blog(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    d = catalogue.with_blog(t.feeds, t.blogs.filter("is_active"))
    return d.select("id", F.col("blog.name").alias("blog_name"), F.col("blog.url").alias("blog_url"))


@query(sql("blogs feeds subscriptions", "SELECT s.id, b.name AS blog_name, coalesce(f.name, b.name) AS shown_name FROM subscriptions s LEFT JOIN blogs b ON b.id = s.blog_id LEFT JOIN feeds f ON f.id = s.feed_id"))
def j05_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    d = catalogue.with_blog(t.subscriptions, t.blogs)
    d = d.join(t.feeds.select(F.col("id").alias("feed_id"), F.col("name").alias("feed_name")), "feed_id", "left")
    return d.select("id", F.col("blog.name").alias("blog_name"), F.coalesce("feed_name", "blog.name").alias("shown_name"))


COUNTED = "(SELECT blog_id, tag, count(*) AS n FROM posts GROUP BY blog_id, tag)"


@query(sql("blogs posts feeds", f"SELECT f.id, coalesce(CASE WHEN coalesce(f.tag_filter, '') <> '' THEN c.n ELSE b.post_count END, 0) AS n_posts FROM feeds f LEFT JOIN {COUNTED} c ON c.blog_id = f.blog_id AND c.tag = f.tag_filter LEFT JOIN blogs b ON b.id = f.blog_id"))
def a02_feed_counts_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return catalogue.feed_counts(t.feeds, t.blogs, t.posts).select("id", "n_posts")


@query(sql("posts feeds", f"SELECT f.id, coalesce(CASE WHEN coalesce(f.tag_filter, '') <> '' THEN c.n ELSE w.n END, 0) AS n_posts FROM feeds f LEFT JOIN {COUNTED} c ON c.blog_id = f.blog_id AND c.tag = f.tag_filter LEFT JOIN (SELECT blog_id, count(*) AS n FROM posts GROUP BY blog_id) w ON w.blog_id = f.blog_id"))
def a03_feed_counts_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return catalogue.feed_counts(t.feeds, t.blogs, t.posts, counted=True).select("id", "n_posts")


@query(sql("posts", "SELECT blog_id, tag, count(*) AS n FROM posts GROUP BY blog_id, tag"))
def j06_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.tag_counts(Tables(spark, sf_dir).posts)


@query(sql("subscriptions", "SELECT subscriber_id, count(*) AS n, count(*) >= 3 AS at_limit FROM subscriptions WHERE is_active AND NOT is_completed GROUP BY subscriber_id"))
def a04_active_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.at_limit(Tables(spark, sf_dir).subscriptions)


AWAITING = ["Author 2", "Author 5"]


@query(sql("blogs feeds", """SELECT author, string_agg(name, '|' ORDER BY name, slug) AS feeds, CAST(row_number() OVER (ORDER BY CASE WHEN author IN ('Author 2', 'Author 5') THEN 1 ELSE 0 END, author) AS INTEGER) AS place
  FROM (SELECT f.name, f.slug, coalesce(nullif(b.author, ''), 'Unknown') AS author FROM feeds f JOIN blogs b ON b.id = f.blog_id WHERE f.is_active) GROUP BY author"""))
def a05_catalogue_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    d = t.feeds.filter("is_active").join(t.blogs.select(F.col("id").alias("blog_id"), "author"), "blog_id")
    return catalogue.by_author(d, AWAITING).select("author", F.array_join("feeds", "|").alias("feeds"), "place")


@query(sql("posts", "SELECT blog_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT blog_id, tag FROM posts) GROUP BY blog_id"))
def a06_blog_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.blog_tags(Tables(spark, sf_dir).posts).select("blog_id", F.array_join("tags", ",").alias("tags"))


@query("""WITH d AS (SELECT DISTINCT p_brand AS theme, p_type AS path FROM part), t AS (SELECT theme, row_number() OVER (ORDER BY theme) AS position FROM (SELECT DISTINCT theme FROM d))
  SELECT path, string_agg(theme, ',' ORDER BY position) AS themes FROM d JOIN t USING (theme) GROUP BY path""")
def a07_inverted_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes (brands) with their paths (types), turned round."""
    d = Tables(spark, sf_dir).table("part").groupBy(F.col("p_brand").alias("theme")).agg(F.collect_set("p_type").alias("paths"))
    d = d.withColumn("position", F.row_number().over(Window.orderBy("theme")))  # a row for each theme
    return catalogue.inverted(d).select("path", F.array_join("themes", ",").alias("themes"))


@query("""SELECT host, page_id, url FROM (SELECT split_part(url, '/', 3) AS host, page_id, url, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) AS r FROM pages) WHERE r = 1""")
def a08_first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).table("pages").select(F.try_parse_url("url", F.lit("AUTHORITY")).alias("host"), "page_id", "url")
    return merge.first_by(d, ["host"], [F.asc("page_id")])


@query("SELECT DISTINCT split_part(url, '/', 3) AS host FROM pages")
def a09_distinct_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).table("pages").select(F.try_parse_url("url", F.lit("AUTHORITY")).alias("host")).distinct()


@query(sql("posts", "SELECT blog_id, count(*) AS post_count, count(*) FILTER (published_at IS NOT NULL) AS dated, count(*) FILTER (content_text = '') AS empty, CAST(sum(length(content_text)) AS BIGINT) AS letters FROM posts GROUP BY blog_id"))
def a10_blog_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).posts
    return d.groupBy("blog_id").agg(F.count("*").alias("post_count"), F.count("published_at").alias("dated"), F.count_if(F.col("content_text") == "").alias("empty"), F.sum(F.length("content_text").cast("long")).alias("letters"))


@query(sql("posts", "SELECT count(*) AS n FROM posts WHERE blog_id = 'src1' AND tag = 'en'"))
def a01_filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).posts.filter((F.col("blog_id") == "src1") & F.array_contains("tags", "en"))
    return d.agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT lower(url) AS k, url, page_id FROM (SELECT CASE WHEN page_id % 2 = 0 THEN upper(split_part(url, '/', 3)) ELSE split_part(url, '/', 3) END AS url, page_id FROM pages))
  SELECT k AS key, arg_min(url, page_id) AS url, CAST(count(*) AS INTEGER) AS vote_count FROM v GROUP BY k""")
def a14_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).table("pages")
    host = F.try_parse_url("url", F.lit("AUTHORITY"))
    votes = d.select(F.when(F.col("page_id") % 2 == 0, F.upper(host)).otherwise(host).alias("url"), F.col("page_id").alias("ts"))
    empty = spark.createDataFrame([], "id string, url string, vote_count int, status string, created_at timestamp, updated_at timestamp")
    return merge.count_votes(empty, votes, F.lit(AS_OF).cast("timestamp")).select(F.lower("url").alias("key"), "url", "vote_count")


@query(sql("posts", "SELECT id, blog_id, CAST(row_number() OVER (PARTITION BY blog_id ORDER BY coalesce(nullif(published_at, ''), '0000'), original_url) AS INTEGER) AS place FROM posts"))
def wn01_index_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by date with undated posts first (sort T-01)."""
    d = catalogue.numbered(Tables(spark, sf_dir).posts, ["blog_id"], [catalogue.dated(), F.asc("original_url")], "place", F.substring(catalogue.dated(), 1, 7))
    return d.select("id", "blog_id", "place")


@query(sql("posts", "SELECT id, blog_id, CAST(row_number() OVER (PARTITION BY blog_id ORDER BY coalesce(nullif(published_at, ''), '9999'), original_url) AS INTEGER) AS place FROM posts"))
def t02_index_undated_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalogue.numbered(Tables(spark, sf_dir).posts, ["blog_id"], [catalogue.dated(False), F.asc("original_url")], "place", F.substring(catalogue.dated(False), 1, 7))
    return d.select("id", "blog_id", "place")


@query(sql("posts", """SELECT id, series, CAST(row_number() OVER (ORDER BY series, id) AS INTEGER) AS post_index FROM (
  SELECT id, CASE WHEN tag = 'en' THEN 0 ELSE 1 END AS series FROM posts)"""))
def wn02_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).posts
    english = F.coalesce(F.col("tag") == "en", F.lit(False))
    parts = [p.filter(own).select("id", F.lit(i).alias("series")) for i, own in enumerate((english, ~english))]
    return catalogue.concatenated(parts, [F.asc("id")])


TURNS = "SELECT conv_id, turn, role, length(text) AS letters, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS place FROM conversations"


@query(f"SELECT conv_id, turn, place FROM (SELECT *, 1 FROM ({TURNS})) WHERE letters > 60")
def wn04_index_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalogue.numbered(Tables(spark, sf_dir).table("conversations"), ["conv_id"], [F.asc("turn"), F.asc("role"), F.asc("text")], "place")
    return d.filter(F.length("text") > 60).select("conv_id", "turn", "place")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS place FROM conversations WHERE length(text) > 60")
def wn03_dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).table("conversations").filter(F.length("text") > 60)
    return catalogue.numbered(d, ["conv_id"], [F.asc("turn"), F.asc("role"), F.asc("text")], "place").select("conv_id", "turn", "place")


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1000) AS until FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def wn07_section_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).table("conversations").select("conv_id", "turn").distinct()
    return catalogue.sections(d, "conv_id", "turn", F.lit(1000), F.floor(F.col("turn") / 2))


@query(sql("posts", "SELECT id, place FROM (SELECT id, CAST(row_number() OVER (PARTITION BY blog_id ORDER BY post_index) AS INTEGER) AS place FROM posts WHERE tag = 'en') WHERE place <= 50"))
def wn05_first_fifty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalogue.feed_posts(F.lit("en"), Tables(spark, sf_dir).posts)
    return catalogue.numbered(d, ["blog_id"], [F.asc("post_index")], "place", F.floor(F.col("post_index") / ROWS_OF_A_BLOG)).filter("place <= 50").select("id", "place")


@query("SELECT s_suppkey, CAST((row_number() OVER (ORDER BY s_name, s_suppkey) - 1) % 10 AS INTEGER) AS colour FROM supplier")
def wn08_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).table("supplier")
    return catalogue.coloured(d.select("s_suppkey", "s_name"), [F.asc("s_name"), F.asc("s_suppkey")], F.left("s_name", F.lit(15))).select("s_suppkey", "colour")


@query("WITH v AS (SELECT lower(event_type) || '-' || CAST(user_id AS VARCHAR) AS id, count(*) AS vote_count, min(ts) AS created_at FROM events GROUP BY 1) SELECT id, vote_count, created_at FROM v ORDER BY vote_count DESC, created_at, id LIMIT 20")
def t07_top_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).table("events").groupBy(F.concat_ws("-", F.lower("event_type"), F.col("user_id").cast("string")).alias("id")).agg(F.count("*").alias("vote_count"), F.min("ts").alias("created_at"))
    return catalogue.top_requests(d)


@query(sql("blogs feeds", f"SELECT '{APP}' AS url, CAST(1.0 AS DOUBLE) AS priority UNION ALL SELECT '{APP}/feeds/' || slug, CAST(0.8 AS DOUBLE) FROM feeds WHERE is_active UNION ALL SELECT '{APP}/blogs/' || slug, CAST(0.7 AS DOUBLE) FROM blogs WHERE is_active"))
def u01_site_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return catalogue.site_entries(APP, t.feeds, t.blogs, [("", 1.0)])


REQUESTED = "(SELECT o_custkey AS subscriber_id, 'src' || CAST(o_orderkey % 20 AS VARCHAR) || ':en' AS feed_id FROM orders)"


def _requests(t: Tables) -> DataFrame:
    return t.table("orders").select(F.col("o_custkey").alias("subscriber_id"), F.concat(F.lit("src"), (F.col("o_orderkey") % 20).cast("string"), F.lit(":en")).alias("feed_id"))


@query(sql("subscriptions", f"SELECT q.subscriber_id, q.feed_id FROM {REQUESTED} q WHERE EXISTS (SELECT 1 FROM subscriptions s WHERE s.is_active AND s.subscriber_id = q.subscriber_id AND s.feed_id = q.feed_id)"))
def p09_already_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return checks.already_subscribed(_requests(t), t.subscriptions, True)


@query(sql("subscriptions", f"SELECT q.subscriber_id, q.feed_id FROM {REQUESTED} q WHERE EXISTS (SELECT 1 FROM subscriptions s WHERE s.subscriber_id = q.subscriber_id AND s.feed_id = q.feed_id)"))
def p10_already_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return checks.already_subscribed(_requests(t), t.subscriptions, False)


@query(sql("subscriptions", f"SELECT DISTINCT q.subscriber_id, q.feed_id FROM {REQUESTED} q WHERE NOT EXISTS (SELECT 1 FROM subscriptions s WHERE s.subscriber_id = q.subscriber_id AND s.feed_id = q.feed_id)"))
def j08_new_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _requests(t).distinct().join(t.subscriptions.select("subscriber_id", "feed_id"), ["subscriber_id", "feed_id"], "left_anti")


@query("SELECT p_brand AS k0, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand HAVING count(*) > 1")
def k01_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.repeated_keys(Tables(spark, sf_dir).table("part"), [F.col("p_brand")])


@query("SELECT doc_id FROM labels l WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 3 <> 0)")
def k02_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return checks.orphans(t.table("labels"), "doc_id", t.documents.filter(F.col("doc_id") % 3 != 0), "doc_id").select("doc_id")


@query(sql("subscriptions", "SELECT id FROM subscriptions WHERE NOT coalesce(preferred_day BETWEEN 0 AND 6, true) OR NOT coalesce(preferred_hour + 5 BETWEEN 0 AND 23, true)"))
def k03_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).subscriptions.withColumn("preferred_hour", F.col("preferred_hour") + 5)
    return checks.out_of_range(d).select("id")


@query(sql("subscriptions", "SELECT id, feed_id FROM subscriptions WHERE subscriber_id = 7"))
def r02_own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.own_rows(Tables(spark, sf_dir).subscriptions, "subscriber_id", F.lit(7)).select("id", "feed_id")


@query(sql("feeds", "SELECT id, CASE WHEN coalesce(tag_filter, '') = '' THEN 'All' ELSE tag_filter END AS label FROM feeds WHERE is_active"))
def prj09_feed_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).feeds.filter("is_active")
    return d.select("id", F.when(F.coalesce("tag_filter", F.lit("")) == "", "All").otherwise(F.col("tag_filter")).alias("label"))


@query(sql("subscriptions", "SELECT id, CASE WHEN is_completed THEN 'Completed' WHEN NOT is_active THEN 'Paused' ELSE 'Next: ' || strftime(next_send_at, '%Y-%m-%d') END AS label FROM subscriptions"))
def prj10_status_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).subscriptions.select("id", delivery.status_label(F.col("is_active"), F.col("is_completed"), F.col("next_send_at")).alias("label"))


@query(sql("blogs", "SELECT id, coalesce(nullif(author, ''), 'Unknown') AS author, 'Read ' || name || ' by ' || coalesce(nullif(author, ''), 'Unknown') || ', ' || CAST(post_count AS VARCHAR) || ' posts' AS description FROM blogs"))
def prj13_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = F.coalesce(F.nullif("author", F.lit("")), F.lit("Unknown"))
    return Tables(spark, sf_dir).blogs.select("id", author.alias("author"), F.concat(F.lit("Read "), "name", F.lit(" by "), author, F.lit(", "), F.col("post_count").cast("string"), F.lit(" posts")).alias("description"))


@query("SELECT n_name, c_name FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE lower(c_mktsegment) = lower('Building')")
def p11_case_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    c = t.table("customer").filter(F.lower("c_mktsegment") == F.lower(F.lit("Building")))
    return c.join(t.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "c_name")


@query(sql("posts", "SELECT id, post_index FROM posts WHERE content_text IS NOT NULL AND length(content_text) >= 100"))
def p08_long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).posts
    return d.filter(F.col("content_text").isNotNull() & (F.length("content_text") >= 100)).select("id", "post_index")
