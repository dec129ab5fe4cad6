"""Queries of the smaller projections, predicates, orders, functions and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim.functions import dates, text, urls
from seriatim.operators import catalogue, checks, merge
from seriatim.plans.binding import Tables, sql
from seriatim.plans.registry import query


@query(sql("posts", "SELECT id, coalesce(title, '') AS title, original_url AS url, coalesce(published_at, '') AS published_at, 1 AS n_tags FROM posts"))
def prj04_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a post file with their defaults."""
    p = Tables(spark, sf_dir).posts
    return p.select("id", F.coalesce("title", F.lit("")).alias("title"), F.col("original_url").alias("url"), F.coalesce("published_at", F.lit("")).alias("published_at"), F.size(F.coalesce("tags", F.array().cast("array<string>"))).alias("n_tags"))


@query(sql("blogs feeds", "SELECT f.id, coalesce(nullif(CASE WHEN f.tag_filter = 'en' THEN '' END, ''), b.url) AS source_url, coalesce(nullif(b.author, ''), 'Unknown') AS author FROM feeds f JOIN blogs b ON b.id = f.blog_id"))
def prj05_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    own = F.when(F.col("tag_filter") == "en", "")
    d = t.feeds.select("id", "blog_id", own.alias("source_url")).join(t.blogs.select(F.col("id").alias("blog_id"), "url", "author"), "blog_id")
    return d.select("id", F.coalesce(F.nullif("source_url", F.lit("")), "url").alias("source_url"), F.coalesce(F.nullif("author", F.lit("")), F.lit("Unknown")).alias("author"))


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN 'Introduction — ' || p_name ELSE 'Ch ' || CAST(p_size AS VARCHAR) || ': ' || p_brand || ' — ' || p_name END AS title, 'No. ' || CAST(p_partkey AS VARCHAR) || ': ' || p_name AS paper FROM part")
def prj12_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    title = F.when(F.col("p_size") == 1, F.concat(F.lit("Introduction — "), "p_name")).otherwise(F.concat(F.lit("Ch "), size, F.lit(": "), "p_brand", F.lit(" — "), "p_name"))
    return Tables(spark, sf_dir).table("part").select("p_partkey", title.alias("title"), F.concat(F.lit("No. "), F.col("p_partkey").cast("string"), F.lit(": "), "p_name").alias("paper"))


@query(sql("blogs", "SELECT id, CASE WHEN author IN ('Author 2', 'Author 5') THEN 'Awaiting permission' ELSE CAST(coalesce(post_count, 0) AS VARCHAR) || ' posts' END AS card FROM blogs WHERE is_active"))
def prj14_feed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of active blogs: a status for authors on the list (P-12), else the count."""
    d = Tables(spark, sf_dir).blogs.filter("is_active")
    count = F.concat(F.coalesce("post_count", F.lit(0)).cast("string"), F.lit(" posts"))
    return d.select("id", F.when(F.col("author").isin("Author 2", "Author 5"), "Awaiting permission").otherwise(count).alias("card"))


@query(sql("posts", "SELECT id, post_index FROM posts WHERE tag = 'fr'"))
def p05_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.feed_posts(F.lit("fr"), Tables(spark, sf_dir).posts).select("id", "post_index")


@query(sql("posts", "SELECT id FROM posts WHERE content_html IS NOT NULL AND content_html <> ''"))
def p07_not_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).posts
    return d.filter(F.col("content_html").isNotNull() & (F.col("content_html") != "")).select("id")


@query("SELECT doc_id, CASE WHEN text = '' OR starts_with(text, '1.') OR length(text) > 100 THEN 'Untitled' ELSE text END AS title FROM documents")
def p19_title_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("text") == "") | F.col("text").startswith("1.") | (F.length("text") > 100)
    return Tables(spark, sf_dir).documents.select("doc_id", F.when(bad, "Untitled").otherwise(F.col("text")).alias("title"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, min(coalesce(nullif(position('?' IN text), 0), 1000000)) AS first_question FROM conversations GROUP BY conv_id")
def a15_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and filtered lengths (A-15) and the least cut position (A-16)."""
    d = Tables(spark, sf_dir).table("conversations")
    at = F.coalesce(F.nullif(F.instr("text", "?"), F.lit(0)), F.lit(1_000_000))
    return d.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.min(at).cast("long").alias("first_question"))


@query(sql("posts", "SELECT a.id, b.id AS next_id FROM posts a JOIN posts b ON b.blog_id = a.blog_id AND b.post_index = a.post_index + 1"))
def wn06_next_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).posts
    b = p.select("blog_id", (F.col("post_index") - 1).alias("post_index"), F.col("id").alias("next_id"))
    return p.select("blog_id", "post_index", "id").join(b, ["blog_id", "post_index"]).select("id", "next_id")


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 THEN 999 ELSE p_size END, p_partkey) AS INTEGER) AS place FROM part")
def t03_chapter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by chapter, 999 where it is unknown."""
    d = Tables(spark, sf_dir).table("part").withColumn("ord", F.when(F.col("p_size") <= 25, F.col("p_size")))
    return catalogue.numbered(d, ["p_brand"], [F.coalesce("ord", F.lit(999)), F.asc("p_partkey")], "place", F.coalesce("ord", F.lit(999))).select("p_partkey", "place")


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END DESC NULLS FIRST, o_orderkey) AS INTEGER) AS place FROM orders")
def t06_latest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending with nulls first."""
    d = Tables(spark, sf_dir).table("orders").withColumn("at", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")))
    return catalogue.numbered(d, ["o_custkey"], [F.desc_nulls_first("at"), F.asc("o_orderkey")], "place").select("o_orderkey", "place")


@query("SELECT p_brand, string_agg(p_type, ',' ORDER BY encode(p_type)) AS types FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand")
def t09_binary_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).table("part")
    return d.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT p_partkey, lower('chapter-' || CAST(p_size AS VARCHAR) || '-slug-7-' || p_brand) AS file, lower(p_brand) AS slug FROM part")
def f24_file_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.concat(F.lit("chapter-"), F.col("p_size").cast("string"), F.lit("-slug-7-"), "p_brand"))
    return Tables(spark, sf_dir).table("part").select("p_partkey", name.alias("file"), F.regexp_replace(name, r"^chapter-\d+-(?:slug-\d+-)?", "").alias("slug"))


@query("SELECT r_regionkey, CASE r_name WHEN 'ASIA' THEN 'Asia, all of it' WHEN 'EUROPE' THEN 'Europe' ELSE r_name END AS shown FROM region")
def f30_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"ASIA": "Asia, all of it", "EUROPE": "Europe"}
    return Tables(spark, sf_dir).table("region").select("r_regionkey", text.display_name(F.col("r_name"), names).alias("shown"))


@query("SELECT page_id, split_part(url, '/', 3) AS authority, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path, starts_with(url, 'http://') OR starts_with(url, 'https://') AS absolute FROM pages")
def f41_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return Tables(spark, sf_dir).table("pages").select("page_id", urls.authority(u).alias("authority"), urls.path(u).alias("path"), urls.is_absolute(u).alias("absolute"))


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) = 8 THEN 'Augu ' || CAST(day(o_orderdate) AS VARCHAR) || ', ' || CAST(year(o_orderdate) AS VARCHAR) ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS iso FROM orders")
def f72_month_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates by month's name with an ordinal suffix; August stays as the suffixes' removal leaves it."""
    raw = F.concat(F.lit("It was "), F.date_format("o_orderdate", "MMMM d"), F.lit("th, "), F.date_format("o_orderdate", "yyyy"), F.lit(" there"))
    return Tables(spark, sf_dir).table("orders").select("o_orderkey", dates.month_date(raw).alias("iso"))


@query(sql("subscriptions", "SELECT id, timezone(coalesce(timezone, 'UTC'), timezone('UTC', next_send_at)) AS local_time, date_trunc('day', next_send_at) + to_hours(coalesce(preferred_hour, 9)) AS at_hour FROM subscriptions"))
def f76_local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local wall time (F-76), and the day's start with an hour added (F-77)."""
    d = Tables(spark, sf_dir).subscriptions
    at = F.col("next_send_at").cast("timestamp")
    hour = F.make_dt_interval(F.lit(0), F.coalesce(F.col("preferred_hour").cast("int"), F.lit(9)))
    return d.select("id", F.from_utc_timestamp(at, F.coalesce("timezone", F.lit("UTC"))).cast("timestamp_ntz").alias("local_time"), (F.date_trunc("day", at) + hour).cast("timestamp_ntz").alias("at_hour"))


@query(sql("subscribers", "SELECT coalesce(s.id, n.id) AS id, coalesce(n.email, s.email) AS email, coalesce(n.is_confirmed, s.is_confirmed) AS is_confirmed FROM subscribers s FULL JOIN (SELECT s_suppkey * 20 AS id, lower(s_name) || '@example.net' AS email, true AS is_confirmed FROM supplier) n ON n.id = s.id"))
def d13_confirmed_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations merged in, with their addresses in lower case."""
    t = Tables(spark, sf_dir)
    new = t.table("supplier").select((F.col("s_suppkey") * 20).alias("id"), F.concat(F.lower("s_name"), F.lit("@example.net")).alias("email"), F.lit(True).alias("is_confirmed"))
    return merge.upsert(t.subscribers.select("id", "email", "is_confirmed"), new, ["id"])


@query(sql("subscriptions", "SELECT id, false AS added FROM subscriptions UNION ALL SELECT -1, true"))
def d12_test_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).subscriptions.select("id", F.lit(False).alias("added"))
    return merge.insert_absent(d, spark.createDataFrame([(-1, True), (-1, True)], "id long, added boolean"), ["id"])


@query(sql("subscribers", "SELECT id, email FROM subscribers WHERE id = 11"))
def r01_own_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.own_rows(Tables(spark, sf_dir).subscribers, "id", F.lit(11)).select("id", "email")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def k06_allowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.not_in(Tables(spark, sf_dir).table("orders"), "o_orderstatus", ["O", "F"]).select("o_orderkey")


@query("SELECT c_custkey, CAST(count(*) FILTER (c_acctbal > 0) OVER (PARTITION BY c_nationkey) AS BIGINT) AS peers FROM customer")
def a01_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the number of those of the nation in credit: one aggregate, not a count a row."""
    d = Tables(spark, sf_dir).table("customer")
    peers = d.groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("peers"))
    return d.join(peers, "c_nationkey").select("c_custkey", "peers")
