"""Helpers that the operators of this subpackage share: staging in the shared folder, word tables and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a keyed side may be sent to every executor (about 16 bytes a row); larger sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Documents that one numpy step handles at once.
DOCS_AT_ONCE = 512
#: Letters of text that one numpy step handles at once, or one text that has more.
LETTERS_AT_ONCE = 1_000_000
#: Rows whose texts a task turns to Python objects at once.
ROWS_AT_ONCE = 1024
LETTERS = re.compile(r"[^\W\d_]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or a local one in local mode only."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="seriatim-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/seriatim/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Staging:
    """The tables of one run, in a folder of their own within the shared one; ``clear`` deletes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/seriatim/{name}-{uuid.uuid4().hex}", []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back."""
        path = f"{self.root}/{len(self.paths)}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *kept: str) -> None:
        """Deletes all tables but those of the names ``kept``."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            if path.rsplit("/", 1)[1].split("-", 1)[1] not in kept:
                folder = jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)


def unused(name: str, *tables: DataFrame) -> str:
    """A name that no column of ``tables`` has or starts with."""
    return "_" * (1 + max((len(c) for t in tables for c in t.columns), default=0)) + name


def keyed_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within the bound, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text has remainder 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def slices(n: int, step: int = DOCS_AT_ONCE) -> Iterator[slice]:
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def text_slices(all_texts: list[str], letters: int = LETTERS_AT_ONCE) -> Iterator[slice]:
    """Slices of about so many letters, each of one text at least."""
    lo, held = 0, 0
    for i, t in enumerate(all_texts):
        held += len(t)
        if held >= letters:
            yield slice(lo, i + 1)
            lo, held = i + 1, 0
    if lo < len(all_texts):
        yield slice(lo, len(all_texts))


_tidied: set[str] = set()


def tidy(stage: str) -> None:
    """Gives memory that earlier stages have freed back to the system, once a stage: Python workers outlive their tasks."""
    if stage not in _tidied:
        _tidied.add(stage)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)


class WordTable(dict):
    """Words by number in the order of their first sight; ``fresh`` lists those not yet worked on."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def flat(lists: list[list]) -> tuple[list, np.ndarray]:
    """All members in a row, and where each list starts (with the end)."""
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    return [y for x in lists for y in x], ends


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of rows ``ends[i]`` to ``ends[i + 1]``; an empty span sums to 0."""
    out = np.zeros((len(ends) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        out[full] = np.add.reduceat(values, ends[full], axis=0)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums_by(values: np.ndarray, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit digest of the sum of each cell's ``values`` (whatever their order), and the number of them."""
    low = np.bincount(cell, weights=(values & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=cells)
    high = np.bincount(cell, weights=(values >> np.uint64(32)).astype(np.float64), minlength=cells)
    return mixed(low.astype(np.uint64)) ^ mixed(high.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), np.bincount(cell, minlength=cells)


def ngram_ids(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word's character n-grams, with marks at its ends, and of the ``whole`` word if asked for.

    Returns all numbers in a row and where each word's start.  A word that is shorter than every size and not taken
    whole has none.
    """
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    stop = np.repeat(ends, lengths)
    at = np.arange(len(points))
    found, owners = [], []
    with np.errstate(over="ignore"):
        rolled = np.full(len(points), 0xCBF29CE484222325, np.uint64)
        for n in range(1, max(sizes, default=0) + 1):
            rolled = rolled[: len(points) - n + 1]
            rolled = (rolled ^ points[n - 1 :]) * np.uint64(0x100000001B3)
            if n in sizes:
                fits = at[: len(rolled)] + n <= stop[: len(rolled)]
                found.append(mixed(rolled[fits] + np.uint64(n)) % np.uint64(buckets))
                owners.append(owner[: len(rolled)][fits])
        if whole and len(words):
            place = at - np.repeat(ends - lengths, lengths)
            powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
            hashed = np.add.reduceat(mixed(points) * powers[place], ends - lengths)
            found.append(mixed(hashed) % np.uint64(buckets))
            owners.append(np.arange(len(words)))
    if not found or not len(words):
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    ids, owner = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(words)), out=starts[1:])
    return ids[order], starts


#: A key with more than one in so many rows is hot; so there are fewer hot keys than that.
HOT_SHARE = 1000
#: Parts over which a hot key is dealt.
HOT_PARTS = 64


def join_shared(left: DataFrame, right: DataFrame, key: str, copies: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``key`` and in ``copies`` the number of left rows with it.

    Hot keys (fewer than HOT_SHARE of them, so they are named in the plan) are dealt over HOT_PARTS parts: the right row
    is repeated and left rows are spread by their other columns.
    """
    total = right.agg(F.sum(copies)).first()[0] or 0
    hot = [r[0] for r in right.filter(F.col(copies) * HOT_SHARE > total).select(key).collect()]
    if not hot:
        return left.join(right.drop(copies), key, how)
    parts, part = F.when(F.col(key).isin(hot), HOT_PARTS).otherwise(1), unused("part", left, right)
    others = [c for c in left.columns if c != key] or [key]
    spread = left.withColumn(part, F.pmod(F.xxhash64(*others), parts).cast("int"))
    dealt = right.drop(copies).withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.join(dealt, [key, part], how).drop(part)
