"""The engine's jobs by name, over a folder of tables (``Store``): clean, upload, subscribe, check, send, and what messages tell.

Every job takes the tables, a batch and an instant, and writes only the buckets of the keys that the batch touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim import schemas
from seriatim.functions import html
from seriatim.operators import delivery, merge
from seriatim.streaming.events import KeyedTable

#: The tables with their columns and keys.
TABLES = {
    "blogs": (schemas.BLOGS, ["slug"]),
    "posts": (schemas.POSTS, ["blog_id", "post_index"]),
    "subscribers": (schemas.SUBSCRIBERS, ["email"]),
    "subscriptions": (schemas.SUBSCRIPTIONS, ["id"]),
    "email_log": (schemas.EMAIL_LOG, ["subscription_id", "post_id"]),
}
TEMPLATE = '<!doctype html><html><head><meta charset="utf-8"></head><body><p><a href="{{post_url_utm}}">{{blog_name}}</a></p><h1>{{post_title}}</h1><div>{{post_content}}</div><p>{{progress_text}} ({{progress_pct}}%)</p><p><a href="{{unsubscribe_url}}">Unsubscribe</a> <a href="{{app_url}}">Home</a></p></body></html>'


class Store:
    """Tables in a folder that all tasks see; each change is a new version of the buckets that it touches."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32) -> None:
        self.spark = spark
        self.tables = {name: KeyedTable(spark, f"{folder.rstrip('/')}/{name}", keys, buckets) for name, (_, keys) in TABLES.items()}
        for t in self.tables.values():
            t.last = t.newest()

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read(TABLES[name][0])

    def rows(self, name: str) -> int:
        return self.read(name).count()

    def shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` with the table's columns, null where they have none."""
        kinds = self.spark.createDataFrame([], TABLES[name][0]).schema
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows with new keys are added, those with known ones replace them but for columns that ``rows`` lacks; ``rows`` has each key once."""
        keys, given = TABLES[name][1], [c for c in rows.columns if c not in TABLES[name][1]]
        shaped = self.shaped(name, rows)

        t = self.tables[name]
        t.merge(shaped, 0 if t.last is None else t.last + 1, lambda old, new: merge.upsert(old, new, keys, given))

    def insert(self, name: str, rows: DataFrame) -> None:
        t = self.tables[name]
        t.insert(self.shaped(name, rows), 0 if t.last is None else t.last + 1)


def _id(*parts: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def clean(posts: DataFrame, base: str) -> DataFrame:
    """Posts with cleaned content, plain text, excerpt, word count and minutes; ``cleaned`` has the pictures."""
    d = html.clean(posts, "content_html", F.lit(base))
    return d.withColumns({"content_html": F.col("cleaned.html"), "content_text": F.col("cleaned.text"), "excerpt": F.col("cleaned.excerpt"), "word_count": F.col("cleaned.word_count"), "reading_time_minutes": F.col("cleaned.reading_time_minutes")})


def upload(store: Store, blogs: DataFrame, posts: DataFrame, as_of: Column) -> None:
    """Blogs (slug, name, url, and maybe more) and their posts (slug of the blog as blog, post_index and the rest), known ones replaced; counts are those of ``posts``."""
    counts = posts.groupBy(F.col("blog").alias("slug")).agg(F.count("*").cast("int").alias("post_count"))
    given = blogs.drop("post_count").join(counts, "slug", "left").withColumn("post_count", F.coalesce("post_count", F.lit(0)))
    known = store.read("blogs").select("slug", F.col("id").alias("_id"))
    given = given.join(known, "slug", "left").withColumn("id", F.coalesce("_id", _id(F.lit("blog"), "slug"))).drop("_id")
    rows = given.withColumn("updated_at", as_of)
    store.upsert("blogs", rows.withColumn("is_active", F.lit(True)) if "is_active" not in rows.columns else rows)
    ids = store.read("blogs").select(F.col("slug").alias("blog"), F.col("id").alias("blog_id"))
    url = F.col("url") if "original_url" not in posts.columns else F.col("original_url")
    d = posts.join(ids, "blog").withColumns({"id": _id(F.lit("post"), "blog_id", F.col("post_index").cast("string")), "original_url": url, "published_at": F.try_to_timestamp(F.col("published_at").cast("string"))})
    store.upsert("posts", d.drop("blog", *(["url"] if "url" in d.columns else [])))


def subscribe(store: Store, requests: DataFrame, as_of: Column) -> DataFrame:
    """Confirmed subscriptions, due at once, for ``requests`` (email, blog: its slug, frequency_days); the requests whose blog isn't there."""
    asked = requests.withColumn("email", F.lower("email"))
    blogs = store.read("blogs").select(F.col("slug").alias("blog"), F.col("id").alias("blog_id"))
    known = asked.join(blogs, "blog").dropDuplicates(["email", "blog_id"])
    people = known.select("email").distinct().withColumns({"id": _id(F.lit("subscriber"), "email"), "is_confirmed": F.lit(True), "confirmed_at": as_of})
    store.upsert("subscribers", people)
    rows = known.select(_id(F.lit("subscription"), _id(F.lit("subscriber"), "email"), "blog_id").alias("id"), _id(F.lit("subscriber"), "email").alias("subscriber_id"), "blog_id", F.lit(0).alias("current_post_index"), "frequency_days", as_of.alias("next_send_at"), F.lit(True).alias("is_active"), F.lit(False).alias("is_completed"))
    store.upsert("subscriptions", rows)
    return asked.join(blogs, "blog", "left_anti").select(*requests.columns)


def check(store: Store, as_of: Column) -> DataFrame:
    """What is due."""
    return delivery.due(store.read("subscriptions"), store.read("subscribers"), store.read("blogs"), store.read("posts"), as_of, store.rows("blogs"))


def send(store: Store, letters: str, as_of: Column, app_url: str, source: str, reply_to: str | None = None, limit: int | None = None, dry_run: bool = False) -> int:
    """Writes the letters that are due as JSON lines to the new folder ``letters`` and marks them as sent; how many there are.

    What the log has already isn't sent again.  A folder that is whole is a run that stopped after it was written: its
    letters stand, and only what is still to be marked is marked, so a repeated run loses and doubles nothing.
    """
    due = delivery.outbox(check(store, as_of), TEMPLATE, app_url, source, limit, reply_to)
    due = due.join(store.read("email_log").select("subscription_id", "post_id"), ["subscription_id", "post_id"], "left_anti")
    if dry_run:
        return due.count()
    path = store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{letters}/_SUCCESS")
    if not path.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        due.write.mode("overwrite").json(letters)
    sent = store.spark.read.schema(due.schema).json(letters)
    marks = sent.select("subscription_id", "post_id", "post_index", _id(F.lit("message"), "subscription_id", "post_id").alias("message_id"))
    unmarked = marks.select(F.col("subscription_id").alias("id"), (F.col("post_index") - 1).alias("current_post_index"))
    touched = store.read("subscriptions").join(unmarked, ["id", "current_post_index"], "left_semi")
    state, log = delivery.mark_sent(touched, store.read("blogs"), marks, as_of, blog_rows=store.rows("blogs"))
    store.insert("email_log", log.withColumn("id", _id("subscription_id", "post_id")))
    store.upsert("subscriptions", state)
    return sent.count()


def apply_events(store: Store, events: DataFrame) -> None:
    """First opens and clicks of messages (message_id, event_type, ts) into the log; times that it has stay."""
    found = delivery.first_events(events)
    log = store.read("email_log").join(found.select(F.col("message_id").alias("resend_message_id")), "resend_message_id", "left_semi")
    store.upsert("email_log", delivery.apply_first_events(log, found))
