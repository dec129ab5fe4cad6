"""Queries of state transitions: each takes a state and a batch of events and returns the new state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim.operators import delivery, merge
from seriatim.plans.binding import AS_OF, Tables, sql
from seriatim.plans.registry import query
from seriatim.streaming import events


def _at():
    return F.lit(AS_OF).cast("timestamp")


def _subscriptions(t: Tables) -> DataFrame:
    """The bound subscriptions with the columns that transitions write."""
    d = t.subscriptions.withColumn("next_send_at", F.col("next_send_at").cast("timestamp"))
    return d.withColumns({c: F.lit(None).cast("timestamp") for c in ("last_sent_at", "paused_at", "updated_at")})


def _sent(t: Tables) -> DataFrame:
    return delivery.due(t.subscriptions, t.subscribers, t.blogs, t.posts, t.as_of, t.blog_rows).select("subscription_id", "post_id", F.concat(F.lit("m"), F.col("subscription_id").cast("string")).alias("message_id"))


SENT = f"""SELECT s.id FROM subscriptions s JOIN subscribers u ON u.id = s.subscriber_id JOIN blogs b ON b.id = s.blog_id JOIN posts p ON p.blog_id = s.blog_id AND p.post_index = s.current_post_index + 1
  WHERE s.is_active AND NOT s.is_completed AND s.next_send_at <= TIMESTAMP '{AS_OF}' AND u.is_confirmed"""
VIEWS = "blogs posts subscribers subscriptions"
_DAY = f"date_trunc('day', timezone(coalesce(timezone, 'America/New_York'), timezone('UTC', TIMESTAMP '{AS_OF}'))) + to_days(frequency_days)"
_NEXT = f"""timezone('UTC', timezone(coalesce(timezone, 'America/New_York'), {_DAY} + to_days(CASE WHEN preferred_day IS NOT NULL AND frequency_days >= 7 THEN CAST((preferred_day - dayofweek({_DAY}) + 7) % 7 AS INTEGER) ELSE 0 END) + to_hours(coalesce(preferred_hour, 9))))"""


def _marked(later: str, more: str = "") -> str:
    return sql(VIEWS, f"""SELECT s.id, CAST(CASE WHEN x.id IS NOT NULL THEN current_post_index + 1 ELSE current_post_index END AS INTEGER) AS current_post_index,
  CASE WHEN x.id IS NOT NULL THEN {later} ELSE next_send_at END AS next_send_at, CASE WHEN x.id IS NOT NULL THEN current_post_index + 1 >= b.post_count ELSE is_completed END AS is_completed
  FROM subscriptions s LEFT JOIN ({SENT}{more}) x ON x.id = s.id LEFT JOIN blogs b ON b.id = s.blog_id""")


def _shown(d: DataFrame) -> DataFrame:
    return d.select("id", "current_post_index", F.col("next_send_at").cast("timestamp_ntz").alias("next_send_at"), "is_completed")


@query(_marked(_NEXT))
def d07_mark_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _shown(delivery.mark_sent(_subscriptions(t), t.blogs, _sent(t), _at(), blog_rows=t.blog_rows)[0])


@query(_marked(_NEXT, " AND s.id % 5 <> 0"))
def st03_delivery_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of the loop: what is due, without what the log has as sent, marked as sent."""
    t = Tables(spark, sf_dir)
    due = delivery.due(t.subscriptions, t.subscribers, t.blogs, t.posts, t.as_of, t.blog_rows).select("subscription_id", "post_id")
    fresh = events.deliver(due, due.filter("subscription_id % 5 = 0"))
    return _shown(delivery.mark_sent(_subscriptions(t), t.blogs, fresh.withColumn("message_id", F.lit("m")), _at(), blog_rows=t.blog_rows)[0])


@query(sql(VIEWS, SENT.replace("SELECT s.id FROM", "SELECT s.id AS subscription_id, p.id AS post_id, CASE WHEN s.id % 5 = 0 THEN 'before' ELSE 'm' END AS resend_message_id FROM")))
def st03_delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after that run: what it had, and what was sent, each letter once."""
    t = Tables(spark, sf_dir)
    due = delivery.due(t.subscriptions, t.subscribers, t.blogs, t.posts, t.as_of, t.blog_rows).select("subscription_id", "post_id")
    log = due.filter("subscription_id % 5 = 0").withColumn("resend_message_id", F.lit("before"))
    new = delivery.mark_sent(_subscriptions(t), t.blogs, events.deliver(due, log).withColumn("message_id", F.lit("m")), _at(), blog_rows=t.blog_rows)[1]
    return merge.insert_absent(log, new.select(*log.columns), ["subscription_id", "post_id"])


@query(_marked(f"TIMESTAMP '{AS_OF}' + to_days(frequency_days)"))
def d06_mark_sent_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _shown(delivery.mark_sent(_subscriptions(t), t.blogs, _sent(t), _at(), preferences=False, blog_rows=t.blog_rows)[0])


@query(sql(VIEWS, SENT.replace("SELECT s.id FROM", "SELECT s.id AS subscription_id, p.id AS post_id, 'm' || CAST(s.id AS VARCHAR) AS resend_message_id FROM")))
def d06_sent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return delivery.mark_sent(_subscriptions(t), t.blogs, _sent(t), _at(), blog_rows=t.blog_rows)[1].select("subscription_id", "post_id", "resend_message_id")


@query(sql("blogs", "SELECT coalesce(b.id, n.id) AS id, coalesce(n.name, b.name) AS name, b.author, coalesce(n.post_count, b.post_count) AS post_count FROM blogs b FULL JOIN (SELECT 'src' || CAST(r_regionkey + 18 AS VARCHAR) AS id, r_name AS name, CAST(r_regionkey AS INTEGER) AS post_count FROM region) n ON n.id = b.id"))
def d01_upsert_blogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as blogs: two are known, three are new."""
    t = Tables(spark, sf_dir)
    new = t.table("region").select(F.concat(F.lit("src"), (F.col("r_regionkey") + 18).cast("string")).alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("post_count"))
    return merge.upsert(t.blogs.select("id", "name", "author", "post_count"), new, ["id"])


@query(sql("blogs", "SELECT coalesce(b.id, n.id) AS id, coalesce(b.name, n.name) AS name, coalesce(n.post_count, b.post_count) AS post_count FROM blogs b FULL JOIN (SELECT 'src' || CAST(r_regionkey + 18 AS VARCHAR) AS id, r_name AS name, CAST(r_regionkey AS INTEGER) AS post_count FROM region) n ON n.id = b.id"))
def d02_upsert_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, but names of known blogs stay."""
    t = Tables(spark, sf_dir)
    new = t.table("region").select(F.concat(F.lit("src"), (F.col("r_regionkey") + 18).cast("string")).alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("post_count"))
    return merge.upsert(t.blogs.select("id", "name", "post_count"), new, ["id"], update=["post_count"])


@query("""WITH board AS (SELECT 'Click' AS url, 5 AS vote_count UNION ALL SELECT 'Other', 2), v AS (SELECT lower(event_type) AS k, count(*) AS n FROM events GROUP BY 1)
  SELECT coalesce(lower(b.url), v.k) AS key, CAST(coalesce(b.vote_count, 0) + coalesce(v.n, 0) AS INTEGER) AS vote_count FROM board b FULL JOIN v ON lower(b.url) = v.k""")
def d03_vote_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = spark.createDataFrame([("1", "Click", 5), ("2", "Other", 2)], "id string, url string, vote_count int").withColumns({"status": F.lit("pending"), "created_at": _at(), "updated_at": _at()})
    votes = Tables(spark, sf_dir).table("events").select(F.col("event_type").alias("url"), "ts")
    return merge.count_votes(board, votes, _at()).select(F.lower("url").alias("key"), "vote_count")


@query(sql("subscribers", "SELECT id, email FROM subscribers WHERE id % 2 = 0 UNION ALL SELECT id, email FROM subscribers WHERE id % 3 = 0 AND id % 2 <> 0"))
def d04_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).subscribers.select("id", "email")
    return merge.insert_absent(d.filter("id % 2 = 0"), d.filter("id % 3 = 0"), ["id"])


@query(sql("subscriptions", "SELECT s.id, count(l.l_orderkey) AS letters FROM subscriptions s LEFT JOIN lineitem l ON l.l_orderkey = s.id WHERE s.id % 7 <> 0 GROUP BY s.id"))
def d05_unsubscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions that stay, with the letters in their log."""
    t = Tables(spark, sf_dir)
    log = t.table("lineitem").select(F.col("l_orderkey").alias("subscription_id"))
    subs, rest = delivery.unsubscribe(t.subscriptions, log, t.subscriptions.filter("id % 7 = 0"))
    n = rest.groupBy(F.col("subscription_id").alias("id")).agg(F.count("*").alias("letters"))
    return subs.select("id").join(n, "id", "left").select("id", F.coalesce("letters", F.lit(0)).alias("letters"))


@query(sql("subscriptions", f"""SELECT id, is_active <> (id % 11 = 0) AS is_active, CASE WHEN id % 11 = 0 AND is_active THEN TIMESTAMP '{AS_OF}' END AS paused_at FROM subscriptions"""))
def d10_pause_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _subscriptions(Tables(spark, sf_dir))
    return delivery.toggle(s, s.filter("id % 11 = 0"), _at()).select("id", "is_active", F.col("paused_at").cast("timestamp_ntz").alias("paused_at"))


_D9 = f"date_trunc('day', timezone(coalesce(timezone, 'America/New_York'), timezone('UTC', TIMESTAMP '{AS_OF}' + to_hours(24 * 7))))"


@query(sql("subscriptions", f"""SELECT id, CAST(CASE WHEN id % 13 = 0 THEN 7 ELSE frequency_days END AS INTEGER) AS frequency_days,
  CASE WHEN id % 13 = 0 THEN timezone('UTC', timezone(coalesce(timezone, 'America/New_York'), {_D9} + to_hours(20))) + to_days(CASE WHEN preferred_day IS NULL THEN 0 ELSE CAST((preferred_day - dayofweek({_D9}) + 7) % 7 AS INTEGER) END) ELSE next_send_at END AS next_send_at FROM subscriptions"""))
def d09_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _subscriptions(Tables(spark, sf_dir))
    changes = s.filter("id % 13 = 0").select("id", F.lit(7).alias("frequency_days"), F.lit(None).cast("short").alias("preferred_day"), F.lit(20).cast("short").alias("preferred_hour"))
    return delivery.set_preferences(s, changes, _at()).select("id", "frequency_days", F.col("next_send_at").cast("timestamp_ntz").alias("next_send_at"))


@query(sql("subscriptions", """SELECT DISTINCT o_custkey AS subscriber_id, 'src' || CAST(o_orderkey % 20 AS VARCHAR) || ':en' AS feed_id FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM subscriptions s WHERE s.subscriber_id = o.o_custkey AND s.feed_id = 'src' || CAST(o.o_orderkey % 20 AS VARCHAR) || ':en')"""))
def d08_subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    k = F.col("o_orderkey")
    blog = F.concat(F.lit("src"), (k % 20).cast("string"))
    asked = t.table("orders").select(F.col("o_custkey").alias("subscriber_id"), F.concat(blog, F.lit(":en")).alias("feed_id"), blog.alias("blog_id"), F.lit(7).alias("frequency_days"), F.lit(None).cast("short").alias("preferred_day"), F.lit(9).alias("preferred_hour"), F.lit(None).cast("string").alias("timezone"))
    return delivery.subscribe(t.subscriptions, asked, _at())[0].select("subscriber_id", "feed_id")


FIRST = "SELECT user_id AS message_id, min(ts) FILTER (event_type = 'view') AS opened_at, min(ts) FILTER (event_type = 'click') AS clicked_at FROM events WHERE user_id IS NOT NULL AND event_type IN ('view', 'click') GROUP BY user_id"


@query(FIRST)
def d11_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.first_events(Tables(spark, sf_dir).messages, "view", "click")


_STORED = "CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' END"


@query(f"SELECT c_custkey AS id, coalesce({_STORED}, x.opened_at) AS opened_at, x.clicked_at FROM customer c LEFT JOIN (" + FIRST + ") x ON x.message_id = c.c_custkey")
def d11_log_with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    k, none = F.col("c_custkey"), F.lit(None).cast("timestamp_ntz")
    stored = F.when(k % 2 == 0, F.lit("2024-01-05").cast("timestamp_ntz"))  # what is stored already stays
    log = t.table("customer").select(k.alias("id"), k.alias("resend_message_id"), stored.alias("opened_at"), none.alias("clicked_at"))
    return delivery.apply_first_events(log, delivery.first_events(t.messages, "view", "click")).select("id", "opened_at", "clicked_at")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS parent FROM labels")
def k04_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to documents that are gone become null."""
    t = Tables(spark, sf_dir)
    child = t.table("labels").select("doc_id", F.col("doc_id").alias("parent"))
    return merge.set_null(child, "parent", t.documents.filter("doc_id % 2 = 0"), "doc_id")


@query("SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0")
def k05_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return merge.cascade(t.table("labels").select("doc_id", "quality"), "doc_id", t.documents.filter("doc_id % 2 = 0"), "doc_id")
