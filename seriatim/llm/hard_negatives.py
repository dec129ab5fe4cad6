"""Hard-negative mining over a table of pivot distances.

Vectors get one more component that makes all norms equal, so the inner product with an anchor (whose component is 0)
falls as the Euclidean distance grows.  Every row's distances to ``PIVOTS`` pivots are stored; by the triangle
inequality they bracket the distance, and so the score, of a row and an anchor.  Blocks of rows (sorted by their nearest
pivot) and then single rows whose bracket misses what the anchor looks for are left out; the survivors' scores are
computed exactly.  Pivots that leave nearly all rows alive aren't tried further: the exact check is cheaper.

An anchor looks for its ``positives`` best rows of the same label, and then, for each of them, for its ``negatives`` best
rows of other labels with scores within given percents of the positive's.  Anchors come in blocks of a bounded size, and
tasks keep the best of each; a first pass over one row in ``FIRST_PART`` gives scores that a result must reach at least.

The score is the integer inner product of the components' floor(256 * x).

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; rows
are compared with rows of the same dimension only; rows with the anchor's id aren't its partners; of anchors with one id
the one with the least vector, then label, counts; repeated rows count each; ties go to the smaller id; an anchor with
fewer rows gets all; other columns, whatever their names, are left out; an empty table gives no rows.  Scores must fit a
long.  Pivots are chosen, the farthest first, from a sample of ``SAMPLE`` rows; they change the work, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriatim.llm.common import Staging
from seriatim.llm.topk import scores

ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percents of the positive's score
SCALE = 256.0
PIVOTS, SAMPLE = 16, 1024
#: Pivots tried before it is seen whether they leave rows out.
STEP = 4
FIRST_PART = 64
#: Bytes of a block's anchors, as doubles.
ANCHOR_BYTES = 8_000_000
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 4096, 512
SLACK = 1e-6
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "anchor_id long, slot int, vec_id long, score long"


def usable(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, dim and x of the rows that take part."""
    d = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return d.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & finite).withColumn("dim", F.size("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one dimension as whole numbers."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) * SCALE)


def _norms(d: DataFrame) -> dict[int, float]:
    """The largest norm by dimension (a row for each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                x = _matrix(batch.column("x").filter(pa.array(dims == dim)))
                most[dim] = max(most.get(dim, 0.0), float(np.sqrt((x * x).sum(axis=1)).max()))
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(most), pa.int32()), "norm": pa.array(list(most.values()), pa.float64())})

    rows = d.select("dim", "x").mapInArrow(run, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("norm")).collect()
    return {r["dim"]: r["norm"] for r in rows}


class Pivots:
    """Chosen vectors, and distances to them in the space with one more component."""

    def __init__(self, sample: np.ndarray, norm: float, n: int = PIVOTS) -> None:
        self.square = norm * norm * (1 + 1e-9) + 1
        x, self.extra = sample, self._extra(sample)
        chosen = [0]
        nearest = self._between(x, self.extra, x[:1], self.extra[:1])[:, 0]
        while len(chosen) < min(n, len(x)) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, self._between(x, self.extra, x[chosen[-1:]], self.extra[chosen[-1:]])[:, 0])
        self.x, self.extra = x[chosen], self.extra[chosen]

    def _extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))

    def _between(self, x: np.ndarray, own: np.ndarray, y: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.square - 2 * (x @ y.T + own[:, None] * others[None, :]), 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._between(x, self._extra(x), self.x, self.extra).astype(np.float32)

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.square - 2 * (q @ self.x.T), 0)).astype(np.float32)


def pivot_table(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """The rows of one dimension with their distances to the pivots, each task's sorted by the nearest one."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = shared.value.of_rows(_matrix(batch.column("x")))
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), pa.array(list(d), pa.list_(pa.float32())), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["vec_id", "label", "x", "to_pivots", "near", "nearest"])

    table = rows.select("vec_id", "label", "x").mapInArrow(run, "vec_id long, label long, x array<double>, to_pivots array<float>, near int, nearest float")
    return table.sortWithinPartitions("near", "nearest")


class Wanted:
    """What a block of anchors looks for: ``k`` rows in each slot, of the same label or another one, with scores from ``low`` to ``high``."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, pivots: Pivots, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.q, self.low, self.high, self.k, self.same = ids, labels, q, low, high, k, same
        self.to_pivots, self.total = pivots.of_anchors(q), (q * q).sum(axis=1) + pivots.square
        self.slack = SLACK * np.sqrt(self.total + pivots.square)


class Search:
    """The best rows of one task, by slot, with the least score that still counts."""

    def __init__(self, wanted: Wanted) -> None:
        self.w, self.low = wanted, wanted.low.copy()
        self.cell, self.ids, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def _alive(self, some: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Whether distances from ``near`` to ``far`` allow a score that is looked for; what isn't a number does."""
        w = self.w
        best = (w.total[some][:, None] - np.maximum(near - w.slack[some][:, None], 0) ** 2) / 2 + 1
        worst = (w.total[some][:, None] - (far + w.slack[some][:, None]) ** 2) / 2 - 1
        return ~(best < self.low[some].min(axis=1)[:, None]) & ~(worst > w.high[some].max(axis=1)[:, None])

    def add(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, d: np.ndarray) -> None:
        w = self.w
        for lo in range(0, len(w.ids), ANCHORS_AT_ONCE):
            some = np.arange(lo, min(lo + ANCHORS_AT_ONCE, len(w.ids)))
            to = w.to_pivots[some]
            near = np.maximum(np.maximum(to - d.max(axis=0), d.min(axis=0) - to), 0).max(axis=1, initial=0)
            far = (to + d.max(axis=0)).min(axis=1, initial=np.inf)
            some = some[self._alive(some, near[:, None], far[:, None])[:, 0]]  # by block
            if not len(some):
                continue
            alive, to = np.ones((len(some), len(ids)), bool), w.to_pivots[some]
            near, far = np.zeros(alive.shape, np.float32), np.full(alive.shape, np.inf, np.float32)
            for j in range(d.shape[1]):
                np.maximum(near, np.abs(to[:, j, None] - d[None, :, j]), out=near)
                np.minimum(far, to[:, j, None] + d[None, :, j], out=far)
                if j % STEP == STEP - 1 or j == d.shape[1] - 1:
                    alive = self._alive(some, near, far)  # by row
                    if alive.mean() > 0.875:
                        break
            rows, asked = np.flatnonzero(alive.any(axis=0)), alive.any(axis=1)
            if len(rows):
                self._check(some[asked], alive[asked][:, rows], ids[rows], labels[rows], x[rows])
        self._best()

    def _check(self, some: np.ndarray, alive: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        w = self.w
        s = scores(w.q[some], x)
        fits = alive & (ids[None, :] != w.ids[some][:, None]) & ((labels[None, :] == w.labels[some][:, None]) == w.same)
        slots = self.low.shape[1]
        for slot in range(slots):
            i, j = np.nonzero(fits & (s >= self.low[some, slot][:, None]) & (s <= w.high[some, slot][:, None]))
            if len(i):
                self.cell, self.ids, self.score = np.concatenate([self.cell, some[i] * slots + slot]), np.concatenate([self.ids, ids[j]]), np.concatenate([self.score, s[i, j]])

    def _best(self) -> None:
        order = np.lexsort((self.ids, -self.score, self.cell))
        cell = self.cell[order]
        place = np.arange(len(cell)) - np.searchsorted(cell, cell)
        order = order[place < self.w.k]
        self.cell, self.ids, self.score = self.cell[order], self.ids[order], self.score[order]
        last = np.flatnonzero(place[place < self.w.k] == self.w.k - 1)
        flat = self.low.reshape(-1)
        flat[self.cell[last]] = np.maximum(flat[self.cell[last]], self.score[last])

    def out(self) -> pa.RecordBatch:
        slots = self.low.shape[1]
        return pa.RecordBatch.from_pydict({"anchor_id": self.w.ids[self.cell // slots], "slot": (self.cell % slots).astype(np.int32), "vec_id": self.ids, "score": self.score})


def _searched(table: DataFrame, wanted: Wanted) -> DataFrame:
    """The best ``k`` rows (rank from 1) of every anchor and slot."""
    shared = table.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                d = part.column("to_pivots").flatten().to_numpy().reshape(part.num_rows, -1)
                search.add(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("x")), d)
        yield search.out()

    found = table.select("vec_id", "label", "x", "to_pivots").mapInArrow(run, FOUND)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted.k)


def _bounded(table: DataFrame, wanted: Wanted) -> Wanted:
    """The same, with the least scores that the k-th of a part of the rows allows."""
    at = {i: n for n, i in enumerate(wanted.ids.tolist())}
    part = table.filter(F.pmod(F.xxhash64("vec_id"), F.lit(FIRST_PART)) == 0)
    for r in _searched(part, wanted).filter(F.col("rank") == wanted.k).collect():  # a row for an anchor of the block and slot
        spot = at[r["anchor_id"]], r["slot"]
        wanted.low[spot] = max(int(wanted.low[spot]), r["score"])
    return wanted


def _blocks(anchors: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and whole vectors of up to ``size`` anchors at a time."""
    held: list = []
    for r in anchors.select("vec_id", "label", "x").toLocalIterator():
        held.append(tuple(r))
        if len(held) == size:
            yield _arrays(held)
            held = []
    if held:
        yield _arrays(held)


def _arrays(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, x = zip(*held, strict=True)
    return np.array(ids, np.int64), np.array(labels, np.int64), np.floor(np.array(x) * SCALE)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``rows`` and ``anchors`` as ``usable`` gives them."""
    spark = rows.sparkSession
    stage = Staging(spark, "hard-negatives")
    path = f"{stage.root}/found"
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kind).write.parquet(path)
    anchors = anchors.groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("least")).select("vec_id", "least.label", "least.x").withColumn("dim", F.size("x"))
    for dim, norm in sorted(_norms(rows).items()):
        own = rows.filter(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).select("x").collect()
        pivots = Pivots(np.floor(np.array([r["x"] for r in sample]) * SCALE), norm)
        table = stage(pivot_table(own, pivots), f"pivots-{dim}")
        for ids, labels, q in _blocks(anchors.filter(F.col("dim") == dim), max(1, anchor_bytes // (8 * dim))):
            shape = (len(ids), 1)
            first = _searched(table, _bounded(table, Wanted(ids, labels, q, pivots, np.full(shape, LEAST), np.full(shape, MOST), positives, True)))
            at = {i: n for n, i in enumerate(ids.tolist())}
            floor, ceiling = np.full((len(ids), positives), MOST), np.full((len(ids), positives), LEAST)
            told = []
            for r in first.collect():  # ``positives`` rows for an anchor of the block
                spot = at[r["anchor_id"]], r["rank"] - 1
                floor[spot], ceiling[spot] = -(-low * r["score"] // 100), high * r["score"] // 100
                told.append((r["anchor_id"], r["rank"] - 1, r["vec_id"], r["score"]))
            if not told:
                continue
            of = F.broadcast(spark.createDataFrame(told, "anchor_id long, slot int, positive_id long, positive_score long"))
            found = _searched(table, _bounded(table, Wanted(ids, labels, q, pivots, floor, ceiling, negatives, False)))
            found.join(of, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    stage.clear()
    return spark.read.schema(kind).parquet(path)


def report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``ANCHOR_EVERY``; every seventh id's label is the next of ten."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = usable(embeddings, moved)
    return mine(rows, rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0))
