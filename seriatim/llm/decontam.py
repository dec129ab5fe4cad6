"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item, or a shorter item as a whole.  Documents and items are
fingerprinted alike: of all k-grams in a sliding span of as many words as a window has, the least hash is kept, so
neighbouring spans mostly keep the same one and a span that both sides have keeps the same on both.  Fingerprints of
documents are joined with those of the benchmark, first on a bitmap of a fixed size that every task has, and each hit is
extended to the spans that kept it, which are compared with the benchmark's windows by their words.  No shared window is
missed and none is reported by accident of a hash.

With up to ``WINDOWS`` windows (counted) the comparison takes place where the document is read, and no row moves.  With
more, candidate spans are joined with the windows by shuffle.  Both give the same rows.

Defined cases: null has no words, as an empty or wordless text; items without words have no windows, and those without
an id mark words but are not listed; several items of one id count once; repeated rows of documents are marked each;
texts are taken whole, however long; other columns stay, whatever their names; without documents there are no rows, and
without a benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriatim.llm.common import Staging, WordTable, mixed, small, text_slices, texts, unused

WINDOW = 10
#: Windows (with their items) up to which every task has them all, and their bytes.
WINDOWS, WINDOW_BYTES = 200_000, 32_000_000
#: Bits of the bitmap of the benchmark's fingerprints.
BITS = 1 << 25
#: Words whose hashes a task keeps at most.
CACHE_WORDS = 300_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes to lower case, and to a blank what stands in no word.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SPANS = "array<struct<start:long,stop:long>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


class Hashes:
    """64-bit hashes of words, each word hashed once."""

    def __init__(self) -> None:
        self.words, self.hashes = WordTable(), np.zeros(0, np.uint64)

    def __call__(self, lists: list[list[bytes]]) -> np.ndarray:
        """Of all words of all lists, in a row."""
        if len(self.words) > CACHE_WORDS:
            self.words, self.hashes = WordTable(), np.zeros(0, np.uint64)
        number = np.fromiter((self.words[w] for words in lists for w in words), np.int64, sum(map(len, lists)))
        if self.words.fresh:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, self.words.fresh), np.uint64, len(self.words.fresh))])
            self.words.fresh = []
        return self.hashes[number]


def kept(h: np.ndarray, n: int) -> np.ndarray:
    """The least k-gram hash of every ``n`` consecutive word hashes; k is half of n, rounded up."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    k = (n + 1) // 2
    grams = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        grams = grams * GOLDEN + h[i : len(grams) + i]
    grams = mixed(grams ^ np.uint64(n))
    least = grams[: len(h) - n + 1].copy()
    for i in range(1, n - k + 1):
        np.minimum(least, grams[i : len(least) + i], out=least)
    return least


def _of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in small(batches):
        for item, text in zip(batch.column("item").to_pylist(), texts(batch), strict=True):
            words = words_of(text)
            if not words:
                continue
            n = min(WINDOW, len(words))
            keys = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            prints = kept(hashes([words]), n).view(np.int64)
            yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(keys), pa.string()), "n": pa.array([n] * len(keys), pa.int32()), "key": pa.array(keys, pa.binary()), "kept": pa.array(prints)})


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, n (words), key (the words) and kept (the fingerprint) of every window of every item, each once."""
    d = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_of_items, "item string, n int, key binary, kept long").distinct()


def _place(kept: Column) -> Column:
    return F.pmod(kept, F.lit(BITS)) + 1


def bitmap(found: DataFrame) -> bytes:
    """A bit for each fingerprint's place: ``BITS`` bits, gathered in at most 1,024 rows."""
    parts = found.groupBy(F.bitmap_bucket_number(_place(F.col("kept"))).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_place(F.col("kept")))).alias("bits"))
    rows = {r["part"]: bytes(r["bits"]) for r in parts.collect()}
    size = 32768
    return b"".join(rows.get(i, b"").ljust(size // 8, b"\0") for i in range(1, BITS // size + 1))


class Matcher:
    """Spans of documents that may be, or are, windows of the benchmark."""

    def __init__(self, sizes: list[int], bits: bytes, keys: dict[bytes, list[str]] | None) -> None:
        self.sizes, self.bits, self.keys, self.hashes = sizes, np.frombuffer(bits, np.uint8), keys, Hashes()

    def candidates(self, lists: list[list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """Number of the document, first word and words of every span whose fingerprint the bitmap has."""
        h = self.hashes(lists)
        ends = np.cumsum([0, *map(len, lists)])
        owner = np.repeat(np.arange(len(lists)), np.diff(ends))
        for n in self.sizes:
            least = kept(h, n)
            if not len(least):
                continue
            runs = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))  # where another hash begins to be kept
            place = (least[runs] % np.uint64(BITS)).astype(np.int64)
            hit = (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            spans = np.flatnonzero(np.repeat(hit, np.diff(np.append(runs, len(least)))))
            spans = spans[owner[spans] == owner[spans + n - 1]]  # of one document
            for s, d in zip(spans.tolist(), owner[spans].tolist(), strict=True):
                yield d, s - int(ends[d]), n

    def __call__(self, all_texts: list[str]) -> tuple[list[int], list[list[tuple[int, int, bytes]]]]:
        """Numbers of words, and candidate spans (start, words, key) of each text; with keys only those that are windows."""
        lists = [words_of(t) for t in all_texts]
        found: list[list[tuple[int, int, bytes]]] = [[] for _ in lists]
        for d, start, n in self.candidates(lists):
            key = b" ".join(lists[d][start : start + n])
            if self.keys is None or key in self.keys:
                found[d].append((start, n, key))
        return [len(x) for x in lists], found


def joined(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Ranges of words that the spans (start, words) cover."""
    out: list[dict[str, int]] = []
    for start, n in sorted(spans):
        if out and start <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], start + n)
        else:
            out.append({"start": start, "stop": start + n})
    return out


def _marked(documents: DataFrame, keep: list[str], text: str, shared, names: tuple[str, str, str]) -> DataFrame:
    spot = unused("text", documents)
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(*shared.value)
        for batch in small(batches):
            all_texts = texts(batch, spot)
            for part in text_slices(all_texts):
                n, found = match(all_texts[part])
                items = [sorted({i for _, _, key in f for i in match.keys[key]}) for f in found]
                spans = [joined([(s, k) for s, k, _ in f]) for f in found]
                rest = [batch.column(i)[part.start : part.stop] for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(spans, arrow), pa.array(items, pa.list_(pa.string()))], names=[*keep, *names])

    kept_columns = documents.select(*keep)
    schema = StructType([*kept_columns.schema.fields, *StructType.fromDDL(f"`{names[0]}` long, `{names[1]}` {SPANS}, `{names[2]}` array<string>").fields])
    return documents.select(*keep, F.col(text).cast("string").alias(spot)).mapInArrow(run, schema)


def _marked_by_shuffle(documents: DataFrame, keep: list[str], text: str, shared, found: DataFrame, stage: Staging, names: tuple[str, str, str]) -> DataFrame:
    spot = unused("text", documents)
    uid, cands = f"{spot}_uid", f"{spot}_spans"
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("key", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(*shared.value)
        for batch in small(batches):
            all_texts = texts(batch, spot)
            for part in text_slices(all_texts):
                n, spans = match(all_texts[part])
                told = [[{"start": s, "n": k, "key": key} for s, k, key in f] for f in spans]
                rest = [batch.column(i)[part.start : part.stop] for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(told, arrow)], names=[*keep, names[0], cands])

    kept_columns = documents.select(*keep)
    schema = StructType([*kept_columns.schema.fields, *StructType.fromDDL(f"`{names[0]}` long, `{cands}` array<struct<start:long,n:long,key:binary>>").fields])
    d = stage(documents.select(*keep, F.col(text).cast("string").alias(spot)).mapInArrow(run, schema).withColumn(uid, F.monotonically_increasing_id()), "scanned")
    spans = d.select(uid, F.explode(cands).alias("c")).select(uid, "c.start", "c.n", "c.key")
    spans = stage(spans.join(found.select("key").distinct(), "key", "left_semi"), "spans")  # AQE splits hot keys
    items = spans.select(uid, "key").distinct().join(found.filter("item is not null").select("key", "item"), "key").select(uid, "item").distinct()
    items = items.groupBy(uid).agg(F.sort_array(F.collect_list("item")).alias(names[2]))
    ordered = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))))

    def merged(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["start"] <= last["stop"], grown).otherwise(F.concat(acc, F.array(x)))

    ranges = spans.groupBy(uid).agg(ordered.alias("s")).select(uid, F.aggregate("s", F.array().cast(SPANS), merged).alias(names[1]))
    out = d.drop(cands).join(ranges, uid, "left").join(items, uid, "left")
    return out.select(*keep, names[0], F.coalesce(names[1], F.array().cast(SPANS)).alias(names[1]), F.coalesce(names[2], F.array().cast("array<string>")).alias(names[2]))


def mark(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, prefix: str = "", item: str = "item_id", text: str = "text", most: int = WINDOWS) -> DataFrame:
    """``documents`` (or the columns ``keep``) with words (their number), spans (ranges of words inside windows) and items (ids, sorted), named with ``prefix``."""
    keep = documents.columns if keep is None else keep
    names = tuple(f"{prefix}{x}" for x in ("words", "spans", "items"))
    stage = Staging(documents.sparkSession, "decontamination")
    found = stage(windows(benchmark, item, text), "windows")
    total, size = found.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    sizes = sorted(r["n"] for r in found.select("n").distinct().collect())  # WINDOW numbers at most
    context = documents.sparkSession.sparkContext
    if total > most or size > WINDOW_BYTES:
        return _marked_by_shuffle(documents, keep, text, context.broadcast((sizes, bitmap(found), None)), found, stage, names)
    keys: dict[bytes, list[str]] = {}
    for r in found.select("key", "item").collect():  # counted above
        own = keys.setdefault(bytes(r["key"]), [])
        if r["item"] is not None:
            own.append(r["item"])
    return _marked(documents, keep, text, context.broadcast((sizes, bitmap(found), keys)), names)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a window of the benchmark."""
    p = unused("", documents)
    return mark(documents, benchmark, prefix=p).filter(F.size(f"{p}spans") == 0).select(*documents.columns)


def report(documents: DataFrame, benchmark: DataFrame, most: int = WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    d = mark(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, keep=["doc_id"], most=most)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return d.select("doc_id", F.col("words").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
