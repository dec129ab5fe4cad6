"""Streaming queries over ``events``, run to their end on what is there; their rows equal the batch form's."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim.plans.binding import Tables, sql
from seriatim.plans.registry import query
from seriatim.plans.transitions import FIRST
from seriatim.streaming import events as S
from seriatim.streaming import schedule


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below ``spark.checkpoint.dir``; a local one where it is unset, in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='seriatim-')}"
    return f"{shared.rstrip('/')}/seriatim-engine/{uuid.uuid4().hex}"


def _kept(spark: SparkSession, df: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """The final table of a stream: of running rows in update mode, of new keys in append mode."""
    folder = shared_folder(spark)
    table = S.KeyedTable(spark, f"{folder}/table", keys)
    S.run_available(df, f"{folder}/checkpoint", table.upsert if mode == "update" else table.insert, mode)
    return table.read(df.schema)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Tables(spark, sf_dir).table("events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(FIRST)
def st01_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _events(spark, sf_dir).select(F.col("user_id").alias("message_id"), "event_type", "ts")
    return _kept(spark, S.first_events(d, "view", "click"), ["message_id"])


@query("SELECT lower(event_type) || '/' || CAST(user_id AS VARCHAR) AS url, count(*) AS vote_count FROM events GROUP BY 1")
def st05_running_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _events(spark, sf_dir)
    return _kept(spark, S.running_votes(d, F.concat_ws("/", F.upper("event_type"), F.col("user_id").cast("string"))), ["url"])


@query("SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'signup'")
def st04_new_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _events(spark, sf_dir).filter(F.col("event_type") == "signup").select(F.col("user_id").alias("id"))
    return _kept(spark, d, ["id"], "append")


@query("SELECT CAST(user_id AS VARCHAR) AS message_id, min(ts) FILTER (event_type = 'view') AS opened_at, min(ts) FILTER (event_type = 'click') AS clicked_at FROM events WHERE user_id IS NOT NULL AND event_type IN ('view', 'click') GROUP BY user_id")
def src15_webhook_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bodies of webhook calls, read from a stream as JSON."""
    data = F.struct(F.col("user_id").cast("string").alias("email_id"))
    body = F.to_json(F.struct(F.concat(F.lit("email."), "event_type").alias("type"), data.alias("data")))
    bodies = _events(spark, sf_dir).select(body.alias("value"), F.col("ts").alias("at"))
    return _kept(spark, S.first_events(S.webhook_events(bodies, received=F.col("at")), "email.view", "email.click"), ["message_id"])


def _after_each(parts: list[DataFrame], folder: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over the stream of the parts, started anew after each of them is written (by many tasks, in many files): a part is a batch."""
    for part in parts:
        part.write.mode("append").parquet(folder)
        out = run(part.sparkSession.readStream.schema(parts[0].schema).parquet(folder))
    return out


FIRST_DAY, DAYS = "1998-06-01", 12
_TICK = "(date_trunc('day', {0} - INTERVAL 8 HOUR) + INTERVAL 8 HOUR + CASE WHEN date_trunc('day', {0} - INTERVAL 8 HOUR) + INTERVAL 8 HOUR < {0} THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)"
_ZONE = "coalesce(timezone, 'America/New_York')"
_LOCAL = f"(date_trunc('day', timezone({_ZONE}, timezone('UTC', {{0}}))) + to_days(frequency_days))"
_LATER = f"timezone('UTC', timezone({_ZONE}, {_LOCAL} + to_days(CASE WHEN preferred_day IS NOT NULL AND frequency_days >= 7 THEN CAST((preferred_day - dayofweek({_LOCAL}) + 7) % 7 AS INTEGER) ELSE 0 END) + to_hours(coalesce(preferred_hour, 9))))"
_RUNS = sql("blogs subscribers subscriptions", f"""SELECT subscription_id, post_index, sent_at, next_send_at, is_completed FROM (
  WITH RECURSIVE s AS (
    SELECT s.id, s.current_post_index, b.post_count, s.frequency_days, s.preferred_day, s.preferred_hour, s.timezone, greatest(s.next_send_at, TIMESTAMP '{FIRST_DAY}') AS wanted
    FROM subscriptions s JOIN subscribers u ON u.id = s.subscriber_id JOIN blogs b ON b.id = s.blog_id WHERE s.is_active AND NOT s.is_completed AND u.is_confirmed AND s.current_post_index < b.post_count
  ),
  run AS (
    SELECT id, current_post_index + 1 AS post_index, post_count, frequency_days, preferred_day, preferred_hour, timezone, {_TICK.format('wanted')} AS sent_at FROM s WHERE {_TICK.format('wanted')} < TIMESTAMP '{FIRST_DAY}' + INTERVAL {DAYS} DAY
    UNION ALL
    SELECT id, post_index + 1, post_count, frequency_days, preferred_day, preferred_hour, timezone, due_at FROM (SELECT *, greatest({_TICK.format(_LATER.format('sent_at'))}, sent_at + INTERVAL 1 DAY) AS due_at FROM run) WHERE post_index < post_count AND due_at < TIMESTAMP '{FIRST_DAY}' + INTERVAL {DAYS} DAY
  )
  SELECT id AS subscription_id, CAST(post_index AS INTEGER) AS post_index, sent_at, {_LATER.format('sent_at')} AS next_send_at, post_index >= post_count AS is_completed FROM run)""")


@query(_RUNS)
def st03_delivery_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subscriptions through twelve daily runs as a keyed stream with timers, stopped after their arrival and after five runs, and started again: each letter once, as a loop day by day sends them."""
    t = Tables(spark, sf_dir)
    s = t.subscriptions.filter("is_active and not is_completed").join(t.subscribers.filter("is_confirmed").select(F.col("id").alias("subscriber_id")), "subscriber_id")
    s = s.join(t.blogs.select(F.col("id").alias("blog_id"), F.col("post_count").alias("total_posts")), "blog_id").filter("current_post_index < total_posts")
    kinds = dict(x.split() for x in schedule.CHANGES.split(", "))
    s = s.withColumn("ts", F.lit(FIRST_DAY)).select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()))
    folder = shared_folder(spark)
    parts = [s, schedule.clock(spark, FIRST_DAY, 5), schedule.clock(spark, "1998-06-06", DAYS - 5)]
    out = _after_each(parts, f"{folder}/changes", lambda changes: schedule.deliver_available(changes, folder))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("sent_at", "next_send_at")})


@query("""WITH d AS (SELECT doc_id, source AS blog_id, CASE WHEN doc_id % 5 = 1 THEN 'moved' ELSE lang END AS tag FROM documents WHERE doc_id % 7 <> 3)
SELECT blog_id, tag, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT blog_id, '', count(*) FROM d GROUP BY ALL""")
def a10_counts_by_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by blog and tag after all are added, some change their tag, and some go; the stream is stopped and started again in between."""
    d = Tables(spark, sf_dir).documents
    row = lambda rows, sign, tag: rows.select(F.lit(sign).cast("long").alias("sign"), F.col("source").alias("blog_id"), F.array(tag).alias("tags"))
    lang, moved = F.col("lang"), F.lit("moved")
    retagged = d.filter("doc_id % 5 = 1")
    folder = shared_folder(spark)
    gone = d.filter("doc_id % 7 = 3")
    parts = [row(d, 1, lang), row(retagged, -1, lang), row(retagged, 1, moved), row(gone, -1, F.when(F.col("doc_id") % 5 == 1, moved).otherwise(lang))]
    return _after_each(parts, f"{folder}/changes", lambda changes: S.counted_available(changes, folder))
