"""Deliveries as a stream against a loop day by day, counts kept by changes against a recount, and the keyed table."""

from __future__ import annotations

import datetime as dt
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seriatim.functions import dates
from seriatim.streaming import events as S
from seriatim.streaming import schedule

UTC = dt.timezone.utc
ZONES = [None, "Europe/Berlin", "Asia/Kolkata", "America/New_York"]


def subscriptions(n):
    return [(i, dt.datetime(2024, 3, 1), i % 3, 5, [1, 7, 14][i % 3], None if i % 2 else i % 7, None if i % 5 == 0 else i % 24, ZONES[i % 4], dt.datetime(2024, 2 + i % 2, 1 + i % 12, i % 10, 30)) for i in range(n)]


def put(spark, folder, rows):
    rows.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.02)


def stream(spark, folder, files=1):
    return spark.readStream.schema(schedule.CHANGES).option("maxFilesPerTrigger", files).parquet(folder)


def day_by_day(rows, days):
    state = {r[0]: [r[2], r[3], *r[4:8], max(r[8], r[1]).replace(tzinfo=UTC)] for r in rows}
    out = []
    for day in range(days):
        now = dt.datetime(2024, 3, 1, 8, tzinfo=UTC) + dt.timedelta(days=day)
        for i, s in state.items():
            if s[0] < s[1] and s[6] <= now:
                s[0] += 1
                s[6] = schedule.next_time(now, *s[2:6])
                out.append((i, s[0], now.replace(tzinfo=None), s[6].replace(tzinfo=None), s[0] >= s[1]))
    return sorted(out)


@pytest.mark.parametrize("clocks", [[20], [3, 1, 16]])
def test_deliveries_are_those_of_the_loop(spark, tmp_path, clocks):
    """Over changes of clock time, in one run or several, each going on where the last one stopped."""
    rows, folder = subscriptions(24), str(tmp_path)
    put(spark, f"{folder}/in", spark.createDataFrame(rows, schedule.CHANGES))
    first = dt.date(2024, 3, 1)
    for days in clocks:
        put(spark, f"{folder}/in", schedule.clock(spark, str(first), days))
        first += dt.timedelta(days=days)
        out = schedule.deliver_available(stream(spark, f"{folder}/in"), folder)
        assert sorted(map(tuple, out.collect())) == day_by_day(rows, (first - dt.date(2024, 3, 1)).days)
    again = schedule.deliver_available(stream(spark, f"{folder}/in"), folder)  # nothing new: nothing is sent
    assert again.count() in (0, len(day_by_day(rows, 20)))


def test_changed_preferences_never_move_the_cursor_back(spark, tmp_path):
    folder = str(tmp_path)
    row = (1, dt.datetime(2024, 3, 1), 0, 9, 1, None, 6, "UTC", dt.datetime(2024, 3, 1))
    put(spark, f"{folder}/in", spark.createDataFrame([row], schedule.CHANGES).union(schedule.clock(spark, "2024-03-01", 3)))
    put(spark, f"{folder}/in", spark.createDataFrame([(1, dt.datetime(2024, 3, 4), 0, 9, 7, None, 6, "UTC", dt.datetime(2024, 3, 6))], schedule.CHANGES).union(schedule.clock(spark, "2024-03-04", 11)))
    put(spark, f"{folder}/in", schedule.clock(spark, "2024-03-15", 1))
    out = schedule.deliver_available(stream(spark, f"{folder}/in"), folder)
    assert [(r["post_index"], r["sent_at"].day) for r in out.orderBy("post_index").collect()] == [(1, 1), (2, 2), (3, 3), (4, 6), (5, 13)]


def test_state_is_kept_by_bucket(spark, tmp_path):
    """Far fewer keys of state than subscriptions, as each costs calls of the state's store; letters are still those of the loop."""
    rows, folder = subscriptions(1500), str(tmp_path)
    spark.createDataFrame(rows, schedule.CHANGES).repartition(3).write.parquet(f"{folder}/in")
    schedule.clock(spark, "2024-03-01", 9).write.mode("append").parquet(f"{folder}/in")
    table = S.KeyedTable(spark, f"{folder}/letters", schedule.KEYS)
    with schedule._timers(spark):
        q = S.run_available(schedule.letters(spark.readStream.schema(schedule.CHANGES).parquet(f"{folder}/in")), f"{folder}/progress", table.insert, "append")
    assert sorted(map(tuple, table.read(schedule.LETTERS).collect())) == day_by_day(rows, 9)
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] < len(rows)


def test_changes_of_one_batch_are_taken_by_their_time(spark, tmp_path):
    """Of several subscriptions in one bucket, and of one several times."""
    folder, day = str(tmp_path), lambda n: dt.datetime(2024, 3, n)
    rows = [(i, day(4), 0, 9, 7, None, 6, "UTC", day(6)) for i in (1, 3)] + [(i, day(1), 0, 9, 1, None, 6, "UTC", day(1)) for i in (1, 2, 3)] + [(3, day(8), 0, 9, 1, None, 6, "UTC", None)]
    put(spark, f"{folder}/in", spark.createDataFrame(rows, schedule.CHANGES))
    put(spark, f"{folder}/in", schedule.clock(spark, "2024-03-01", 15))
    changes = stream(spark, f"{folder}/in")
    table = S.KeyedTable(spark, f"{folder}/letters", schedule.KEYS)
    with schedule._timers(spark):
        S.run_available(schedule.letters(changes, buckets=1), f"{folder}/progress", table.insert, "append")
    got = {}
    for r in table.read(schedule.LETTERS).orderBy("post_index").collect():
        got.setdefault(r["subscription_id"], []).append(r["sent_at"].day)
    assert got == {1: [1, 2, 3, 6, 13], 2: list(range(1, 10)), 3: [1, 2, 3, 6]}


def test_next_times_are_those_of_the_columns(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        now = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(527_000))
        rows.append((now.isoformat(sep=" "), rng.choice([1, 3, 7, 14, 30]), rng.choice([None, *range(7)]), rng.choice([None, *range(24)]), rng.choice([*ZONES, "Australia/Lord_Howe", "Pacific/Apia"])))
    d = spark.createDataFrame(rows, "now string, days int, day int, hour int, zone string")
    got = d.select(F.unix_timestamp(dates.next_send_local(F.to_timestamp("now"), F.col("days"), F.col("day"), F.col("hour"), F.col("zone")))).collect()
    want = [schedule.next_time(dt.datetime.fromisoformat(n).replace(tzinfo=UTC), *rest).timestamp() for n, *rest in rows]
    assert [r[0] for r in got] == want


def test_counts_follow_changes(spark, tmp_path):
    rng = random.Random(5)
    folder, known, want = str(tmp_path), [], Counter()
    schema = "sign long, blog_id string, tags array<string>"
    for _ in range(4):
        batch = [(1, f"b{rng.randrange(6)}", rng.sample(["x", "y", "z"], rng.randrange(3)) or None) for _ in range(30)]
        gone = rng.sample(known, len(known) // 2)
        for row in gone:
            known.remove(row)
        known += batch
        put(spark, f"{folder}/in", spark.createDataFrame([*batch, *((-1, b, t) for _, b, t in gone)], schema))
    got = S.counted_available(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder)
    for _, b, tags in known:
        want.update([(b, ""), *((b, t) for t in set(tags or []))])
    assert {(r["blog_id"], r["tag"]): r["n"] for r in got.collect()} == want


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = S.KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    rows = lambda *xs: spark.createDataFrame(list(xs), "k string, n long")
    table.count(rows(*((f"k{i}", 1) for i in range(40))), 0)
    before = table._versions(0)
    assert set(before.values()) == {0} and len(before) > 4
    table.count(rows(("k1", 5), ("k1", -1)), 1)
    after = table._versions(1)
    assert sum(v == 1 for v in after.values()) == 1
    assert {r["k"]: r["n"] for r in table.read("k string, n long").collect()} == {f"k{i}": 1 + 4 * (i == 1) for i in range(40)}
    table.count(rows(("k1", 5), ("k1", -1)), 1)  # the batch comes again
    assert {r["k"]: r["n"] for r in table.read("k string, n long").collect()}["k1"] == 5
    table.count(rows(*((f"k{i}", -1 - 4 * (i == 1)) for i in range(40))), 2)
    assert table.read("k string, n long").count() == 0
    table.count(rows(("new", 2)), 3)
    assert [tuple(r) for r in table.read("k string, n long").collect()] == [("new", 2)]
