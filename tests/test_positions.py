"""Neighbours and places over bucket borders, and arrays that many tasks write."""

from __future__ import annotations

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from seriatim.operators import catalogue
from seriatim.sources import files


def rows_of(seed):
    rng = random.Random(seed)
    rows = [("hot", n, rng.choice([None, f"v{n}"])) for n in rng.sample(range(1000), 300)]
    rows += [(g, n, f"{g}{n}") for g in ("a", "b", None) for n in rng.sample(range(50), 5)] + [("one", 7, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("ahead", [True, False])
@pytest.mark.parametrize("width", [1, 7, 100, None])
def test_neighbours_over_borders(spark, ahead, width):
    """Whatever the buckets, with gaps of many empty ones, null values at borders, and a null group."""
    rows = rows_of(1)
    d = spark.createDataFrame(rows, "g string, n int, v string").repartition(3)
    got = catalogue.neighbour(d, ["g"], ["n"], "v", "next", ahead, None if width is None else F.floor(F.col("n") / width))
    assert got.columns == ["g", "n", "v", "next"]
    want = set()
    for g in {r[0] for r in rows}:
        own = sorted(((n, v) for h, n, v in rows if h == g), reverse=not ahead)
        want |= {(g, n, v, w) for (n, v), (_, w) in zip(own, [*own[1:], (None, None)], strict=True)}
    assert {tuple(r) for r in got.collect()} == want
    assert catalogue.neighbour(d.limit(0), ["g"], ["n"], "v", "next", ahead, F.floor(F.col("n") / 7)).count() == 0


def test_no_task_has_more_than_a_bucket(spark):
    """All rows in one group: the window that looks for neighbours is by group and bucket."""
    d = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("n"))
    got = catalogue.sections(d, "g", "n", F.lit(-1), bucket=F.floor(F.col("n") / 100))
    assert got.filter("until <> n + 1").select("n", "until").collect() == [(4999, -1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) >= 2 and all("bucket" in w for w in windows)


def test_colours_go_round(spark):
    d = spark.createDataFrame([(f"s{n:03d}",) for n in range(25)], "name string").repartition(4)
    got = catalogue.coloured(d, [F.asc("name")], F.left("name", F.lit(3)), 10).orderBy("name").collect()
    assert [r["colour"] for r in got] == [n % 10 for n in range(25)]


def test_large_arrays_are_one_array_end_to_end(spark, tmp_path):
    """A group of nearly all rows is written by several tasks; its parts in the order of their names are one JSON array."""
    rows = [("hot", n, f'line\n"{n}", [x],' if n % 3 else None) for n in range(500)] + [("b", 2, "]"), ("b", 1, "["), ("one", 1, "x,")]
    d = spark.createDataFrame(rows, "g string, n int, t string").repartition(3)
    path = str(tmp_path / "out")
    files.write_large_array(d, path, [F.asc("n")], "g", F.floor(F.col("n") / 50))
    for g in ("hot", "b", "one"):
        parts = sorted(glob.glob(f"{path}/g={g}/part-*"))
        items = json.loads("".join(open(p).read() for p in parts))
        assert [(i["n"], i.get("t")) for i in items] == sorted((n, t) for h, n, t in rows if h == g)
        assert len(parts) > 1 or g != "hot"
    back = files.large_array(spark, path, "n int, t string, missing string")
    assert sorted((r["g"], r["n"], r["t"] or "") for r in back.collect()) == sorted((g, n, t or "") for g, n, t in rows)
    assert back.filter("missing is not null").count() == 0


def test_pictures_stay_written_only_if_there_are_any(spark, tmp_path):
    kind = "cleaned struct<images:array<struct<src:string,alt:string>>>"
    none = spark.createDataFrame([(([],),), ((None,),)], kind)
    assert not files.write_images(none, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    some = spark.createDataFrame([(([("s", "a")],),), (([],),)], kind)
    assert files.write_images(some, str(tmp_path / "some"))
    assert [tuple(r) for r in spark.read.schema("src string, alt string").json(str(tmp_path / "some")).collect()] == [("s", "a")]
