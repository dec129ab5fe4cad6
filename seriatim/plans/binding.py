"""The engine's tables as views of the driver's, in Spark and as SQL; both give the same rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim.operators import catalogue

AS_OF = "1998-06-01 12:00:00"
#: Ids of a blog's posts that are ranked in one task.
ROWS_OF_A_BLOG = 1 << 20

BLOGS_SQL = """blogs AS (
  SELECT source AS id, source AS slug, 'Blog ' || source AS name,
    CASE WHEN CAST(substr(source, 4) AS INTEGER) % 7 = 0 THEN NULL ELSE 'Author ' || CAST(CAST(substr(source, 4) AS INTEGER) % 7 AS VARCHAR) END AS author,
    'https://' || source || '.example.org' AS url, CAST(substr(source, 4) AS INTEGER) % 5 <> 0 AS is_active, CAST(count(*) AS INTEGER) AS post_count
  FROM documents GROUP BY source
)"""
POSTS_SQL = """posts AS (
  SELECT doc_id AS id, source AS blog_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS post_index,
    split_part(text, chr(10), 1) AS title, text AS content_text, '<p>' || text || '</p>' AS content_html,
    'https://' || source || '.example.org/p/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '?ref=x' ELSE '' END AS original_url,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE strftime(DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER), '%Y-%m-%d') END AS published_at,
    lang AS tag
  FROM documents
)"""
FEEDS_SQL = """feeds AS (
  SELECT DISTINCT source || ':all' AS id, source AS blog_id, source || ' in all' AS name, source || '-all' AS slug, CAST(NULL AS VARCHAR) AS tag_filter,
    CAST(substr(source, 4) AS INTEGER) % 4 <> 0 AS is_active FROM documents
  UNION ALL
  SELECT DISTINCT source || ':' || lang, source, source || ' in ' || lang, source || '-' || lang, lang, CAST(substr(source, 4) AS INTEGER) % 4 <> 0 FROM documents
)"""
SUBSCRIBERS_SQL = """subscribers AS (
  SELECT c_custkey AS id, lower(c_name) || '@example.org' AS email, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, c_acctbal > 0 AS is_confirmed FROM customer
)"""
SUBSCRIPTIONS_SQL = """subscriptions AS (
  SELECT o_orderkey AS id, o_custkey AS subscriber_id, 'src' || CAST(o_orderkey % 20 AS VARCHAR) AS blog_id,
    'src' || CAST(o_orderkey % 20 AS VARCHAR) || ':' || CASE o_orderkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'en' ELSE 'fr' END AS feed_id,
    CAST(o_orderkey % 60 AS INTEGER) AS current_post_index, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 14 END AS INTEGER) AS frequency_days,
    CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 7 END AS SMALLINT) AS preferred_day,
    CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 6 + o_orderkey % 15 END AS SMALLINT) AS preferred_hour,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Europe/Berlin' WHEN 2 THEN 'Asia/Kolkata' ELSE 'America/New_York' END AS timezone,
    o_orderdate AS next_send_at, o_orderstatus <> 'P' AS is_active, o_orderstatus = 'F' AS is_completed
  FROM orders
)"""
CTES = {"blogs": BLOGS_SQL, "posts": POSTS_SQL, "feeds": FEEDS_SQL, "subscribers": SUBSCRIBERS_SQL, "subscriptions": SUBSCRIPTIONS_SQL}


def sql(names: str, body: str) -> str:
    """``body`` over the named views."""
    return f"WITH {', '.join(CTES[n] for n in names.split())} {body}"


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp_ntz")

    @cached_property
    def blogs(self) -> DataFrame:
        n = F.substring("source", 4, 10).cast("int")
        d = self.documents.groupBy("source").agg(F.count("*").cast("int").alias("post_count"))
        author = F.when(n % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("Author "), (n % 7).cast("string")))
        return d.select(F.col("source").alias("id"), F.col("source").alias("slug"), F.concat(F.lit("Blog "), "source").alias("name"), author.alias("author"), F.concat(F.lit("https://"), "source", F.lit(".example.org")).alias("url"), (n % 5 != 0).alias("is_active"), "post_count")

    @cached_property
    def blog_rows(self) -> int:
        return self.documents.select("source").distinct().count()

    @cached_property
    def posts(self) -> DataFrame:
        day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")), "yyyy-MM-dd")
        url = F.concat(F.lit("https://"), "source", F.lit(".example.org/p/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "?ref=x").otherwise(""))
        d = catalogue.numbered(self.documents, ["source"], [F.asc("doc_id")], bucket=F.floor(F.col("doc_id") / ROWS_OF_A_BLOG))
        return d.select(F.col("doc_id").alias("id"), F.col("source").alias("blog_id"), "post_index", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content_text"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("content_html"), url.alias("original_url"), F.when(F.col("doc_id") % 7 != 0, day).alias("published_at"), F.col("lang").alias("tag"), F.array("lang").alias("tags"))

    @cached_property
    def feeds(self) -> DataFrame:
        active = (F.substring("source", 4, 10).cast("int") % 4 != 0).alias("is_active")
        none = self.documents.select("source").distinct().withColumn("lang", F.lit(None).cast("string"))
        d = none.unionByName(self.documents.select("source", "lang").distinct())
        tag = F.coalesce("lang", F.lit("all"))
        return d.select(F.concat("source", F.lit(":"), tag).alias("id"), F.col("source").alias("blog_id"), F.concat("source", F.lit(" in "), tag).alias("name"), F.concat("source", F.lit("-"), tag).alias("slug"), F.col("lang").alias("tag_filter"), active)

    @cached_property
    def subscribers(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), (F.col("c_acctbal") > 0).alias("is_confirmed"))

    @cached_property
    def subscriptions(self) -> DataFrame:
        k = F.col("o_orderkey")
        blog = F.concat(F.lit("src"), (k % 20).cast("string"))
        kind = F.when(k % 3 == 0, "all").when(k % 3 == 1, "en").otherwise("fr")
        zone = F.when(k % 4 == 1, "Europe/Berlin").when(k % 4 == 2, "Asia/Kolkata").when(k % 4 == 3, "America/New_York")
        return self.table("orders").select(
            k.alias("id"), F.col("o_custkey").alias("subscriber_id"), blog.alias("blog_id"), F.concat(blog, F.lit(":"), kind).alias("feed_id"), (k % 60).cast("int").alias("current_post_index"), F.when(k % 3 == 0, 1).when(k % 3 == 1, 7).otherwise(14).alias("frequency_days"),
            F.when(k % 4 != 0, k % 7).cast("short").alias("preferred_day"), F.when(k % 5 != 0, 6 + k % 15).cast("short").alias("preferred_hour"), zone.alias("timezone"), F.col("o_orderdate").alias("next_send_at"), (F.col("o_orderstatus") != "P").alias("is_active"), (F.col("o_orderstatus") == "F").alias("is_completed"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        """Open and click events of messages."""
        return self.table("events").select(F.col("user_id").alias("message_id"), "event_type", "ts")
