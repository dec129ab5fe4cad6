"""Delivery as a stream: every subscription has its cursor and the time of its next letter as state, with timers.

Subscriptions lie in buckets by their ids.  A bucket is one key of the stream: its state holds its subscriptions as
columns, and its timer stands at the first of their times, so what a call of the state's store costs is paid a bucket,
not a subscription.

The daily run comes at a fixed hour (``at_hour``, UTC); a letter goes out at the first run at or after a subscription's
next time (and its row's time, as nothing is sent before it is known).  Rows of ``changes`` bring subscriptions, each new row of one replacing what was known of it but never moving
the cursor back; rows without an id are the clock: the watermark that they move makes timers due.  A clock that skips
days makes up for them, so letters are those of a loop run day by day, whatever the batches.  Letters are a table keyed
by subscription and post, into which each batch is inserted once, so a restart sends nothing twice and loses nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seriatim.functions import dates
from seriatim.streaming.events import KeyedTable, run_available

CHANGES = "id long, ts timestamp, current_post_index int, total_posts int, frequency_days int, preferred_day int, preferred_hour int, timezone string, next_send_at timestamp"
LETTERS = "subscription_id long, post_index int, sent_at timestamp, next_send_at timestamp, is_completed boolean"
KEYS = ["subscription_id", "post_index"]
#: Keys of the stream's state; a stream goes on with the number that it began with.
BUCKETS = 64
_ROWS = "subscription_id long, post_index int, sent_at long, next_send_at long, is_completed boolean"
_STATE = "subscriptions binary, due long"
_COLUMNS = {"id": np.int64, "cursor": np.int64, "total": np.int64, "days": np.int64, "day": np.int64, "hour": np.int64, "zone": object, "due": np.int64}
_NONE = -(1 << 31)  # no preferred day or hour
_NEVER = np.iinfo(np.int64).max
_DAY = dt.timedelta(days=1)
_UTC = dt.timezone.utc
_STORE = "spark.sql.streaming.stateStore.providerClass"


def next_time(now: dt.datetime, days: int, day: int | None, hour: int | None, zone: str | None) -> dt.datetime:
    """``dates.next_send_local`` for one instant (aware, in UTC)."""
    own = ZoneInfo(zone or dates.DEFAULT_ZONE)
    d = now.astimezone(own).date() + dt.timedelta(days=days)
    if day is not None and days >= 7:
        d += dt.timedelta(days=(day - d.isoweekday()) % 7)
    local = dt.datetime.combine(d, dt.time()) + dt.timedelta(hours=dates.DEFAULT_HOUR if hour is None else hour)
    return local.replace(tzinfo=own).astimezone(_UTC)


def run_at(wanted: dt.datetime, at_hour: int) -> dt.datetime:
    """The first daily run at or after an instant."""
    run = wanted.replace(hour=at_hour, minute=0, second=0, microsecond=0)
    return run if run >= wanted else run + _DAY


def _run_at(wanted: np.ndarray, at_hour: int) -> np.ndarray:
    """``run_at`` for microseconds, in milliseconds."""
    day, hour = 86_400_000_000, at_hour * 3_600_000_000
    return (-((hour - wanted) // day) * day + hour) // 1000


@lru_cache(maxsize=1 << 16)
def _next(run: int, days: int, day: int, hour: int, zone: str) -> int:
    """``next_time`` in milliseconds; subscriptions of one run share few different ones."""
    now = dt.datetime.fromtimestamp(run / 1000, _UTC)
    return int(next_time(now, days, None if day == _NONE else day, None if hour == _NONE else hour, zone).timestamp() * 1000)


class Deliveries(StatefulProcessor):
    def __init__(self, at_hour: int) -> None:
        self.at_hour = at_hour

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if key[0] is None or pd.isna(key[0]):
            return
        d = pd.concat(frames)
        d = d[d["total"].notna()].sort_values("at", kind="stable")
        if d.empty:
            return
        known, due = self._known(d["id"].to_numpy(np.int64))
        turn = d.groupby("id").cumcount().to_numpy()  # changes of one subscription are taken in turn
        starts = np.flatnonzero(np.diff(turn[order := np.argsort(turn, kind="stable")], prepend=-1))
        for picked in np.split(order, starts[1:]):
            yield from self._changed(known, d.iloc[picked])
        self._keep(known, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, _ = self._known(np.zeros(0, np.int64))
        yield from self._sent(known, np.arange(len(known["id"])), timerValues.getCurrentWatermarkInMs() + 1)
        self._keep(known, None)  # the expired timer goes by itself

    def _known(self, ids: np.ndarray) -> tuple[dict[str, np.ndarray], int | None]:
        """The bucket's subscriptions by id, with new ones for ``ids`` that it lacks, and its timer."""
        known, due = {c: np.zeros(0, kind) for c, kind in _COLUMNS.items()}, None
        if (stored := self.state.get()) is not None:
            packed, due = stored
            table = pa.ipc.open_stream(bytes(packed)).read_all()
            known = {c: table.column(c).to_numpy().astype(kind) for c, kind in _COLUMNS.items()}
        fresh = np.setdiff1d(ids, known["id"])
        if len(fresh):
            order = np.argsort(np.concatenate([known["id"], fresh]), kind="stable")
            new = {"id": fresh, "cursor": _NONE, "zone": "", "due": _NEVER}
            known = {c: np.concatenate([v, np.broadcast_to(np.asarray(new.get(c, 0), v.dtype), len(fresh))])[order] for c, v in known.items()}
        return known, due

    def _keep(self, known: dict[str, np.ndarray], was: int | None) -> None:
        """Stores the bucket and moves its timer to the first time of its subscriptions."""
        first = int(known["due"].min(initial=_NEVER))
        due = None if first == _NEVER else first
        if due != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        out, table = pa.BufferOutputStream(), pa.table({c: pa.array(v, pa.string()).dictionary_encode() if c == "zone" else pa.array(v) for c, v in known.items()})
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        self.state.update((out.getvalue().to_pybytes(), due))

    def _changed(self, known: dict[str, np.ndarray], d: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """One change each of some subscriptions."""
        at, time = np.searchsorted(known["id"], d["id"].to_numpy(np.int64)), d["at"].to_numpy(np.int64)
        yield from self._sent(known, at, time // 1000)  # what was due before the change
        known["cursor"][at] = np.maximum(known["cursor"][at], d["cursor"].to_numpy(np.int64))
        for c in ("total", "days", "day", "hour", "zone"):
            known[c][at] = d[c].to_numpy(_COLUMNS[c])
        wanted = d["wanted"].to_numpy(np.int64)
        goes_on = (known["cursor"][at] < known["total"][at]) & (wanted != _NEVER)
        known["due"][at] = np.where(goes_on, _run_at(np.maximum(np.where(goes_on, wanted, 0), time), self.at_hour), _NEVER)

    def _sent(self, known: dict[str, np.ndarray], at: np.ndarray, before: int | np.ndarray) -> Iterator[pd.DataFrame]:
        """The letters of all runs before an instant (one for all places ``at``, or one each); cursors and times move on."""
        before = np.broadcast_to(before, at.shape)
        while (due := known["due"][at] < before).any():
            at, before = at[due], before[due]
            runs = known["due"][at]
            later = np.fromiter(map(_next, *(v.tolist() for v in (runs, *(known[c][at] for c in ("days", "day", "hour", "zone"))))), np.int64, len(at))
            known["cursor"][at] += 1
            done = known["cursor"][at] >= known["total"][at]
            yield pd.DataFrame({"subscription_id": known["id"][at], "post_index": known["cursor"][at].astype(np.int32), "sent_at": runs, "next_send_at": later, "is_completed": done})
            known["due"][at] = np.where(done, _NEVER, np.maximum(_run_at(later * 1000, self.at_hour), runs + 86_400_000))

    def close(self) -> None:
        pass


def letters(changes: DataFrame, at_hour: int = 8, buckets: int = BUCKETS) -> DataFrame:
    """A stream of letters from a stream of ``CHANGES``, in append mode."""
    preferred = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_NONE)).alias(c.removeprefix("preferred_"))
    d = changes.withWatermark("ts", "0 seconds").select(
        F.when(F.col("id").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(buckets))).cast("int").alias("bucket"), "ts", F.unix_micros("ts").alias("at"), "id",
        F.col("current_post_index").alias("cursor"), F.col("total_posts").alias("total"), F.col("frequency_days").alias("days"), preferred("preferred_day"), preferred("preferred_hour"),
        F.when(F.length("timezone") > 0, F.col("timezone")).otherwise(dates.DEFAULT_ZONE).alias("zone"), F.coalesce(F.unix_micros("next_send_at"), F.lit(int(_NEVER))).alias("wanted"),
    )
    d = d.groupBy("bucket").transformWithStateInPandas(Deliveries(at_hour), _ROWS, "append", "eventTime")
    return d.withColumns({c: F.timestamp_millis(c) for c in ("sent_at", "next_send_at")})


@contextmanager
def _timers(spark: SparkSession) -> Iterator[None]:
    """Timers need the store that keeps state on disk."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def deliver_available(changes: DataFrame, folder: str, at_hour: int = 8) -> DataFrame:
    """Runs what is there of the stream ``changes`` and gives all letters so far; ``folder`` holds the progress and the letters."""
    spark = changes.sparkSession
    table = KeyedTable(spark, f"{folder}/letters", KEYS)
    with _timers(spark):
        run_available(letters(changes, at_hour), f"{folder}/progress", table.insert, "append")
    return table.read(LETTERS)


def clock(spark: SparkSession, first: str, days: int, at_hour: int = 8) -> DataFrame:
    """The daily runs from a day on, as rows of ``CHANGES``."""
    at = F.timestamp_add("HOUR", F.lit(at_hour), F.date_add(F.lit(first).cast("date"), F.col("n").cast("int")).cast("timestamp"))
    columns = [x.split() for x in CHANGES.split(", ")]
    return spark.range(days).withColumnRenamed("id", "n").select(*(at.alias(c) if c == "ts" else F.lit(None).cast(kind).alias(c) for c, kind in columns))
