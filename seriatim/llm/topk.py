"""Exact top-k search by distributed selection on histograms of scores.

Queries come in blocks of ``QUERY_BLOCK``.  For a block, every task scores all its rows in numpy and counts scores by
bucket; the counts are summed, and each query's bucket that holds its k-th score is split into finer buckets, until a
bucket is one score wide.  A last pass returns the rows above that score and, of those at it, the smallest ids.  A
task leaves out buckets below its own k-th score: the global k-th can't be there.

The score is the integer inner product of the components' floor(1024 * x).

Defined cases: a vector that is null or empty, or holds a null or non-finite component, and a row with a null vec_id,
take no part; rows are compared with rows of the same dimension only; rows with the query's vec_id are no candidates;
ties go to the smaller vec_id; repeated candidate rows count each; of query rows with one vec_id the least vector
counts; fewer than k candidates are all returned; other columns, whatever their names, are left out; an empty table
gives no rows.  Scores are exact however large the components; one beyond a long is told, and ranked, as the nearest
long.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriatim.llm.common import shared_folder

K = 10
QUERY_EVERY = 100
QUERY_BLOCK = 2048
BUCKETS = 256
#: Rows that one matrix product takes.
ROWS_AT_ONCE = 4096
EXACT = 2.0**53
#: Largest score; the least is its negative.
MOST = 2**63 - 1
HITS = "query_id long, vec_id long, score long"


def whole(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors (floor(1024 * x), as float64) of the batch's valid rows, by dimension, in parts."""
    column = batch.column("embedding")
    ids = batch.column("vec_id").fill_null(0).to_numpy()
    known = ~batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * 1024.0)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero((size == dim) & known)
        for lo in range(0, len(rows), ROWS_AT_ONCE):
            part = rows[lo : lo + ROWS_AT_ONCE]
            x = values[starts[part][:, None] + np.arange(dim)]
            good = np.isfinite(x).all(axis=1)
            if good.any():
                yield ids[part[good]], x[good]


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, queries x rows: by floats where sums are whole, else by longs, else one by one."""
    most = float(np.abs(queries).max(initial=0)) * np.abs(rows).max(axis=1, initial=0) * queries.shape[1]
    if (most < EXACT).all():
        return (queries @ rows.T).astype(np.int64)
    out = np.empty((len(queries), len(rows)), np.int64)
    for chosen, product in ((most < EXACT, _by_floats), ((most >= EXACT) & (most < 2.0**62), _by_longs), (~(most < 2.0**62), _saturated)):
        if chosen.any():
            out[:, chosen] = product(queries, rows[chosen])
    return out


def _by_floats(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return (queries @ rows.T).astype(np.int64)


def _by_longs(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _saturated(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of any size, within -MOST and MOST.  A sum of longs that wraps is right where the result fits, as a float sum tells but for its error."""
    with np.errstate(all="ignore"):
        about, error = queries @ rows.T, queries.shape[1] * 2.0**-50 * (np.abs(queries) @ np.abs(rows).T)
        fits = lambda x: np.where(np.abs(x) < 2.0**62, x, 0).astype(np.int64)
        out = fits(queries) @ fits(rows).T
        long = (np.abs(queries).max(axis=1, initial=0) < 2.0**62)[:, None] & (np.abs(rows).max(axis=1, initial=0) < 2.0**62)[None, :]
        unsure = ~(long & (np.abs(about) + error < 2.0**63))
        beyond = unsure & (np.abs(about) - error > 2.0**63)
    out[beyond] = np.where(about[beyond] > 0, MOST, -MOST)
    for q, r in zip(*np.nonzero(unsure & ~beyond), strict=True):
        out[q, r] = max(-MOST, min(MOST, sum(int(a) * int(b) for a, b in zip(queries[q], rows[r], strict=True))))
    return out


def _bounds(candidates: DataFrame) -> dict[int, float]:
    """The largest norm of the valid vectors by dimension (a row for each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for batch in batches:
            for _, x in whole(batch):  # a norm may be infinite
                most[x.shape[1]] = max(most.get(x.shape[1], 0.0), float(np.sqrt((x * x).sum(axis=1).max())))
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(most), pa.int32()), "norm": pa.array(list(most.values()), pa.float64())})

    rows = candidates.mapInArrow(run, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("norm")).collect()
    return {r["dim"]: r["norm"] for r in rows}


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of up to ``size`` queries of one dimension; the driver holds a block a dimension and a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in whole(batch):
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "x": pa.array(list(x), pa.list_(pa.float64()))})

    held: dict[int, dict[int, np.ndarray]] = {}
    for row in queries.mapInArrow(run, "vec_id long, x array<double>").groupBy("vec_id").agg(F.min("x").alias("x")).toLocalIterator():
        own = held.setdefault(len(row["x"]), {})
        own[row["vec_id"]] = np.array(row["x"])
        if len(own) == size:
            yield np.array(list(own)), np.stack(list(own.values()))
            own.clear()
    for own in held.values():
        if own:
            yield np.array(list(own)), np.stack(list(own.values()))


def _histogram(candidates: DataFrame, state: dict) -> DataFrame:
    """q, bucket, n: how many scores fall in each of the query's buckets, without those that can't hold the k-th.

    The last buckets may reach over the query's span; scores there are above it, and already counted.
    """
    shared = candidates.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        n = len(s["ids"])
        counts = np.zeros((n, BUCKETS), np.int64)
        base = np.arange(n)[:, None] * BUCKETS
        for batch in batches:
            for ids, x in whole(batch):
                if x.shape[1] != s["x"].shape[1]:
                    continue
                found = scores(s["x"], x)
                over = (found - s["low"][:, None]).view(np.uint64)  # a difference may need all 64 bits
                bucket = over // s["width"][:, None]
                inside = (found >= s["low"][:, None]) & (over < s["span"][:, None]) & (ids[None, :] != s["ids"][:, None]) & s["open"][:, None]
                counts += np.bincount((base + bucket.view(np.int64))[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, bucket = np.nonzero((counts > 0) & (above < s["need"][:, None]))
        yield pa.RecordBatch.from_pydict({"q": q.astype(np.int32), "bucket": bucket.astype(np.int32), "n": counts[q, bucket]})

    return candidates.mapInArrow(run, "q int, bucket int, n long").groupBy("q", "bucket").agg(F.sum("n").alias("n"))


def thresholds(candidates: DataFrame, ids: np.ndarray, x: np.ndarray, norm: float, k: int) -> np.ndarray:
    """The k-th highest score of every query of the block; the lowest possible score where there are fewer candidates."""
    with np.errstate(over="ignore"):
        bound = np.sqrt((x * x).sum(axis=1)) * norm * (1 + 1e-9)
    bound = np.array([int(b) + 1 if b < 2.0**62 else MOST for b in bound], np.int64)  # an infinite norm, too
    low, span = -bound, 2 * bound.astype(np.uint64) + np.uint64(1)
    need, open_ = np.full(len(ids), k, np.int64), np.ones(len(ids), bool)
    while (open_ & (span > 1)).any():
        width = (span - np.uint64(1)) // np.uint64(BUCKETS) + np.uint64(1)
        open_ &= span > 1
        state = {"ids": ids, "x": x, "low": low, "span": span, "width": width, "need": need, "open": open_}
        falling = Window.partitionBy("q").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
        limit = F.element_at(F.array(*map(F.lit, need.tolist())), F.col("q") + 1) if len(set(need.tolist())) > 1 else F.lit(int(need[0]))
        found = _histogram(candidates, state).withColumn("upto", F.sum("n").over(falling)).filter((F.col("upto") >= limit) & (F.col("upto") - F.col("n") < limit))
        got = np.zeros(len(ids), bool)
        for r in found.collect():  # a row for each query of the block
            q = r["q"]
            got[q] = True
            need[q] -= r["upto"] - r["n"]
            low[q] = int(low[q]) + r["bucket"] * int(width[q])
            span[q] = width[q]
        short = open_ & ~got  # fewer candidates than k
        span[short] = 1
        open_ &= got
    return low


def _hits(candidates: DataFrame, ids: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score of rows over the query's threshold and of each task's k smallest ids at it."""
    shared = candidates.sparkSession.sparkContext.broadcast((ids, x, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, vectors, cut = shared.value
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for rows, y in whole(batch):
                if y.shape[1] != vectors.shape[1]:
                    continue
                s = scores(vectors, y)
                q, r = np.nonzero((s >= cut[:, None]) & (rows[None, :] != qs[:, None]))
                out.append((q, rows[r], s[q, r]))
            if not out:
                continue
            q, v, s = (np.concatenate(c) for c in zip(*out, strict=True))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pa.RecordBatch.from_pydict({"query_id": qs[q[keep]], "vec_id": v[keep], "score": s[keep]})

    return candidates.mapInArrow(run, HITS)


def search(embeddings: DataFrame, queries: DataFrame, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows."""
    candidates = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    norms = _bounds(candidates)
    spark, path = candidates.sparkSession, f"{shared_folder(candidates.sparkSession)}/seriatim/topk-{uuid.uuid4().hex}"
    spark.createDataFrame([], HITS).write.parquet(path)
    for ids, x in _blocks(queries, block):
        least = thresholds(candidates, ids, x, norms.get(x.shape[1], 0.0), k)
        _hits(candidates, ids, x, least, k).write.mode("append").parquet(path)  # the plan doesn't grow with the blocks
    found = spark.read.schema(HITS).parquet(path)
    best = [F.desc("score"), F.asc("vec_id")]
    first = Window.partitionBy("query_id", "part").orderBy(*best)
    found = found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(16))).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    last = Window.partitionBy("query_id").orderBy(*best)
    return found.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every(embeddings: DataFrame, step: int = QUERY_EVERY) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by ``step``."""
    return embeddings.filter(F.col("vec_id") % step == 0)
