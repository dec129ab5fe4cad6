"""Deliveries: which subscriptions are due, what they get, and the state after sending.

State never changes row by row: a transition takes the state and a batch of events and gives the new state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.functions import dates, text
from seriatim.operators.catalogue import numbered
from seriatim.operators.merge import first_by, least_by, unused

#: Blogs up to which their table is sent to every executor; the larger is joined by shuffles.
BROADCAST_BLOGS = 200_000
#: Indexes of a blog's posts that are ranked within a tag by one task.
RANKED = 1 << 20


def small(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` with a broadcast hint if its known number of rows is within the bound."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_BLOGS else df


def due(subscriptions: DataFrame, subscribers: DataFrame, blogs: DataFrame, posts: DataFrame, as_of: Column, blog_rows: int | None = None) -> DataFrame:
    """Active, uncompleted subscriptions of confirmed subscribers whose time has come, with the next post.

    A subscription whose next index the blog lacks is not due (see ``stalled``); one without a time isn't either.  With
    the blogs' counted rows within the bound no row moves by its blog alone; posts, which bring the bodies, are joined
    last, by blog and index, where adaptive execution splits what many subscribers wait for.
    """
    s = subscriptions.filter(F.col("is_active") & ~F.col("is_completed") & (F.col("next_send_at") <= as_of))
    s = s.select(F.col("id").alias("subscription_id"), "subscriber_id", "blog_id", (F.col("current_post_index") + 1).alias("post_index"))
    who = subscribers.filter("is_confirmed").select(F.col("id").alias("subscriber_id"), F.col("email").alias("subscriber_email"), F.col("name").alias("subscriber_name"))
    b = blogs.select(F.col("id").alias("blog_id"), F.col("name").alias("blog_name"), F.col("slug").alias("blog_slug"), F.col("post_count").alias("total_posts"))
    p = posts.select("blog_id", "post_index", F.col("id").alias("post_id"), F.col("title").alias("post_title"), F.col("content_html").alias("post_content_html"), F.col("original_url").alias("post_original_url"))
    joined = s.join(who, "subscriber_id").join(small(b, blog_rows), "blog_id").join(p, ["blog_id", "post_index"])
    return joined.select("subscription_id", "subscriber_email", "subscriber_name", "blog_name", "blog_slug", "post_id", "post_title", "post_content_html", "post_original_url", "post_index", "total_posts")


def stalled(subscriptions: DataFrame, posts: DataFrame, as_of: Column) -> DataFrame:
    """Extension: active, uncompleted subscriptions that are overdue but whose next index is missing."""
    s = subscriptions.filter(F.col("is_active") & ~F.col("is_completed") & (F.col("next_send_at") <= as_of))
    s = s.select(F.col("id").alias("subscription_id"), "blog_id", (F.col("current_post_index") + 1).alias("post_index"))
    return s.join(posts.select("blog_id", "post_index"), ["blog_id", "post_index"], "left_anti").select("subscription_id", "blog_id", "post_index")


def due_by_tag(subscriptions: DataFrame, feeds: DataFrame, posts: DataFrame, as_of: Column) -> DataFrame:
    """Extension: due subscriptions where the next post counts within the feed's tag, not the whole blog."""
    f = feeds.select(F.col("id").alias("feed_id"), "blog_id", "tag_filter")
    own = posts.select("blog_id", F.col("id").alias("post_id"), "post_index", F.explode("tags").alias("tag"))
    tagged = numbered(own, ["blog_id", "tag"], [F.asc("post_index"), F.asc("post_id")], "tag_index", F.floor(F.col("post_index") / RANKED)).withColumnRenamed("tag", "tag_filter")
    s = subscriptions.filter(F.col("is_active") & ~F.col("is_completed") & (F.col("next_send_at") <= as_of))
    s = s.select(F.col("id").alias("subscription_id"), "feed_id", (F.col("current_post_index") + 1).alias("tag_index"))
    return s.join(f, "feed_id").join(tagged, ["blog_id", "tag_filter", "tag_index"]).select("subscription_id", "feed_id", "post_id", "tag_index")


def outbox(items: DataFrame, template: str, app_url: str, campaign_source: str, limit: int | None = None, reply_to: str | None = None) -> DataFrame:
    """Letters for due items; ``limit`` (none or 0: all) takes the first by subscription.  With ``reply_to`` they have that address and a List-Unsubscribe header to it."""
    if limit:
        items = items.orderBy("subscription_id").limit(limit)
    url = text.with_campaign(F.col("post_original_url"), campaign_source)
    values = {
        "blog_name": F.col("blog_name"),
        "post_title": F.col("post_title"),
        "post_url": F.col("post_original_url"),
        "post_url_utm": url,
        "post_content": F.col("post_content_html"),
        "progress_text": text.progress_text(F.col("post_index"), F.col("total_posts")),
        "progress_pct": text.progress_percent(F.col("post_index"), F.col("total_posts")),
        "unsubscribe_url": text.unsubscribe_url(app_url, F.col("subscription_id")),
        "app_url": F.lit(app_url),
    }
    back = [] if reply_to is None else [F.lit(reply_to).alias("reply_to"), F.lit(f"<mailto:{reply_to}?subject=unsubscribe>").alias("list_unsubscribe")]
    return items.select("subscription_id", "post_id", "post_index", *back, text.address(F.col("subscriber_name"), F.col("subscriber_email")).alias("recipient"), F.concat_ws(" — ", "post_title", "blog_name").alias("subject"), text.render(F.lit(template), values).alias("html"))


def mark_sent(subscriptions: DataFrame, blogs: DataFrame, sent: DataFrame, as_of: Column, preferences: bool = True, blog_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """New subscriptions, and the log rows, after ``sent`` (subscription_id, post_id, message_id).

    The cursor moves by one, the next time follows the preferences (or, without them, the pace alone), and a
    subscription is completed when the cursor reaches the blog's post count.
    """
    n = F.col("current_post_index") + 1
    if preferences:
        later = dates.next_send_local(as_of, F.col("frequency_days"), F.col("preferred_day"), F.col("preferred_hour"), F.col("timezone"))
    else:
        later = dates.next_send_simple(as_of, F.col("frequency_days"))
    was, total = unused("sent", subscriptions), unused("total", subscriptions)
    hit = sent.select(F.col("subscription_id").alias("id")).distinct().withColumn(was, F.lit(True))
    totals = blogs.select(F.col("id").alias("blog_id"), F.col("post_count").alias(total))
    joined = subscriptions.join(hit, "id", "left").join(small(totals, blog_rows), "blog_id", "left")
    is_sent = F.col(was).isNotNull() & F.col(total).isNotNull()
    new = {"current_post_index": n, "last_sent_at": as_of, "next_send_at": later, "is_completed": n >= F.col(total), "updated_at": as_of}
    state = joined.select(*(F.when(is_sent, new[c]).otherwise(F.col(c)).cast(subscriptions.schema[c].dataType).alias(c) if c in new else F.col(c) for c in subscriptions.columns))
    log = sent.select("subscription_id", "post_id", F.col("message_id").alias("resend_message_id"), as_of.alias("sent_at"))
    return state, log


def subscribe(subscriptions: DataFrame, requests: DataFrame, as_of: Column, arrival: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """New subscriptions for ``requests`` (subscriber_id, feed_id, blog_id, frequency_days, preferred_day, preferred_hour, timezone), and the requests that already have one.

    Of several requests for one feed the first by ``arrival`` (unique) counts; without it, the least by its columns.
    """
    key = ["subscriber_id", "feed_id"]
    first = first_by(requests, key, arrival) if arrival else least_by(requests, key)
    known = subscriptions.select(*key).filter("feed_id is not null").distinct()
    fresh = first.join(known, key, "left_anti")
    already = first.join(known, key, "left_semi")
    later = dates.next_send_instant(as_of, F.col("frequency_days"), F.col("preferred_day"), F.col("preferred_hour"), F.coalesce("timezone", F.lit(dates.DEFAULT_ZONE)))
    new = fresh.withColumn("id", F.sha2(F.concat_ws("|", *key), 256)).withColumn("next_send_at", later).withColumn("current_post_index", F.lit(0)).withColumn("is_active", F.lit(True)).withColumn("is_completed", F.lit(False))
    return new, already


def set_preferences(subscriptions: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """``changes`` (id, frequency_days, preferred_day, preferred_hour; null leaves as it is) take effect, with the next time computed anew."""
    hit = unused("hit", subscriptions)
    c = changes.select("id", *(F.col(x).alias(f"{hit}_{x}") for x in ("frequency_days", "preferred_day", "preferred_hour")), F.lit(True).alias(hit))
    d = subscriptions.join(c, "id", "left")
    new = {x: F.coalesce(f"{hit}_{x}", x) for x in ("frequency_days", "preferred_day", "preferred_hour")}
    later = dates.next_send_instant(as_of, new["frequency_days"], new["preferred_day"], F.coalesce(new["preferred_hour"].cast("int"), F.lit(dates.DEFAULT_HOUR)), F.coalesce("timezone", F.lit(dates.DEFAULT_ZONE)))
    new["next_send_at"] = F.when(F.col(hit), later).otherwise(F.col("next_send_at"))
    return d.select(*(new[x].cast(subscriptions.schema[x].dataType).alias(x) if x in new else F.col(x) for x in subscriptions.columns))


def toggle(subscriptions: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Pauses active and resumes paused subscriptions of ``ids`` (id); the next time stays."""
    name = unused("hit", subscriptions)
    d = subscriptions.join(ids.select("id").distinct().withColumn(name, F.lit(True)), "id", "left")
    hit = F.col(name).isNotNull()
    new = {"is_active": F.when(hit, ~F.col("is_active")).otherwise(F.col("is_active")), "paused_at": F.when(hit & F.col("is_active"), as_of).when(hit, F.lit(None)).otherwise(F.col("paused_at"))}
    return d.select(*(new[x].cast(subscriptions.schema[x].dataType).alias(x) if x in new else F.col(x) for x in subscriptions.columns))


def unsubscribe(subscriptions: DataFrame, log: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subscriptions and log without those of ``ids`` (id)."""
    gone = ids.select("id").distinct()
    return subscriptions.join(gone, "id", "left_anti"), log.join(gone.withColumnRenamed("id", "subscription_id"), "subscription_id", "left_anti")


def status_label(active: Column, completed: Column, next_send: Column) -> Column:
    return F.when(completed, "Completed").when(~active, "Paused").otherwise(F.concat(F.lit("Next: "), F.date_format(next_send, "yyyy-MM-dd")))


def first_events(events: DataFrame, opened: str = "email.opened", clicked: str = "email.clicked") -> DataFrame:
    """message_id, opened_at, clicked_at: each message's first event of either kind; events of other kinds or without id are left out."""
    d = events.filter(F.col("message_id").isNotNull() & F.col("event_type").isin(opened, clicked))
    return d.groupBy("message_id").agg(F.min(F.when(F.col("event_type") == opened, F.col("ts"))).alias("opened_at"), F.min(F.when(F.col("event_type") == clicked, F.col("ts"))).alias("clicked_at"))


def apply_first_events(log: DataFrame, found: DataFrame) -> DataFrame:
    """The log with times of first events where it had none."""
    o, c = unused("opened", log), unused("clicked", log)
    f = found.select(F.col("message_id").alias("resend_message_id"), F.col("opened_at").alias(o), F.col("clicked_at").alias(c))
    new = {"opened_at": F.coalesce("opened_at", o), "clicked_at": F.coalesce("clicked_at", c)}
    return log.join(f, "resend_message_id", "left").select(*(new[c].alias(c) if c in new else F.col(c) for c in log.columns))
