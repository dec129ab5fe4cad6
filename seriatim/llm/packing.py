"""Best-fit packing of tokenized documents into sequences, with matching of large items.

Lengths are whole numbers up to the capacity, so a packing is planned on the histogram of lengths, which is of bounded
size whatever the corpus: pieces above one third of the capacity are matched greedily, two a bin at most; smaller ones
go, longest first, where they fit best.  The plan is a list of runs (length, ranks, bins); each piece finds its place
from its rank among the pieces of its length.  Ranks come from counters within the tasks and counts by task, so no
length's pieces ever meet in one place.

Defined cases: a null text counts as empty and is the end mark alone; a document longer than the capacity, however
long, is cut so that its first piece takes the rest and the others are full; pieces of one length tie and take their
places in any order; repeated rows are packed each on its own; a null doc_id stays null; other columns, whatever their
names, are left out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriatim.llm.bpe import LETTERS_AT_ONCE, Abreast, Encoder, default_path, vocabulary
from seriatim.llm.common import small, staged, text_slices, texts, tidy

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def coder(path: str) -> Encoder:
    """The coder of a task: most of what a corpus's task meets is words that are new to it, and these are merged abreast."""
    return Encoder(v := vocabulary(path), Abreast(v))


def pieces(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A row for each piece: its place in its document, its ids' checksum, and its number among its task's pieces of that length."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy("packing")
        encoder = coder(path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in small(batches):
            all_texts, doc_ids = texts(batch), batch.column("doc_id").fill_null(0).to_numpy()
            nulls = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for part in text_slices(all_texts, LETTERS_AT_ONCE):
                ids, bounds = encoder.encode(all_texts[part])
                total = np.diff(bounds) + 1
                count = -(-total // capacity)
                owner = np.repeat(np.arange(len(total)), count)
                nth_piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                first = total - (count - 1) * capacity
                start = np.where(nth_piece == 0, 0, first[owner] + (nth_piece - 1) * capacity)
                length = np.where(nth_piece == 0, first[owner], capacity)
                whole = np.insert(ids, bounds[1:], END_ID).astype("<u4")
                at = bounds[:-1][owner] + owner + start
                crc = [zlib.crc32(whole[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sorted_lengths = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(order)) - np.searchsorted(sorted_lengths, sorted_lengths) + seen[sorted_lengths]
                seen += np.bincount(length, minlength=capacity + 1)
                own, missing = doc_ids[part][owner], nulls[part][owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64(), mask=missing), pa.array(nth_piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), task), pa.int32()), pa.array(nth, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, PIECES)


@dataclass(frozen=True)
class Run:
    """Pieces of one length, ranks ``rank`` to ``rank + count - 1``: ``each`` a bin from bin ``bin`` on, the first at ``offset``."""

    length: int
    rank: int
    count: int
    bin: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs for all pieces; ``histogram`` has the number of pieces by length.

    The work and the result are bounded by the square of ``capacity``, whatever the counts.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    placed: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # (first bin, bins) by room left
    bins = 0

    def put(length: int, count: int, first: int, each: int, offset: int) -> None:
        runs.append(Run(length, placed[length], count, first, each, offset))
        placed[length] += count
        left[length] -= count

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            gaps.setdefault(room, []).append((first, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] and (m < n or left[n] > 1)), None)
            if mate == n:
                pairs = left[n] // 2
                put(n, 2 * pairs, bins, 2, 0)
            elif mate:
                pairs = min(left[n], left[mate])
                put(n, pairs, bins, 1, 0)
                put(mate, pairs, bins, 1, n)
            else:
                pairs = left[n]
                put(n, pairs, bins, 1, 0)
            leave(capacity - n - (mate or 0), bins, pairs)
            bins += pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            room = min((g for g in gaps if g >= n and gaps[g]), default=None)
            if room is None:
                each = capacity // n
                full, rest = divmod(left[n], each)
                if full:
                    put(n, full * each, bins, each, 0)
                    leave(capacity - each * n, bins, full)
                if rest:
                    put(n, rest, bins + full, rest, 0)
                    leave(capacity - rest * n, bins + full, 1)
                bins += full + bool(rest)
                continue
            first, count = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            each, offset = room // n, capacity - room
            full = min(count, left[n] // each)
            if full:
                put(n, full * each, first, each, offset)
                leave(room - each * n, first, full)
            rest = left[n] if full < count else 0
            if rest:
                put(n, rest, first + full, rest, offset)
                leave(room - rest * n, first + full, 1)
            leave(room, first + full + bool(rest), count - full - bool(rest))
    return runs


def pack(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    found = staged(pieces(documents, capacity, path), "pieces")
    counts = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = staged(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = sorted(plan(histogram, capacity), key=lambda r: (r.length, r.rank))
    table = {k: np.array([getattr(r, k) for r in runs], np.int64) for k in ("length", "rank", "bin", "each", "offset")}
    most = max(histogram.values(), default=0) + 1
    table["key"] = table["length"] * most + table["rank"]
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(t["key"], length * most + rank, side="right") - 1
            steps, within = np.divmod(rank - t["rank"][at], t["each"][at])
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(t["bin"][at] + steps, pa.int64()), pa.array(t["offset"][at] + within * length, pa.int64())], names=[*kept, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = found.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
