"""Similarity self-join of documents on word shingles (Jaccard), by PartEnum signatures.

Sets that are equal count as one.  The others fall into bands of sizes.  Each band partitions the shingle domain in two
levels: parts, and sub-parts of each part.  Two similar sets of the band differ in so few shingles that in some part at
most all but two of the sub-parts are touched; so every subset of two sub-parts is enumerated, and a signature is a
set's projection on one such subset.  A set has the signatures of its own band, and of the next one if that may hold a
larger similar set.  Empty projections have no signature: a set with so many that agreement on a filled one isn't sure
repeats the enumeration with another partition, which a similar set then does too.

Signatures travel as sorted, packed blocks, one for each task and range of signatures; a range's task keeps those that
different sets share.  Of the sets that share a signature the one with most shared signatures is the hub; each set is
first compared with the hub that it shares most signatures with.  What is then of one component needs no comparison:
the rest go through two more passes, each set with its nearest of another component and at last all pairs of different
components.  A sketch, which gives a lower bound of two sets' distance, decides which pairs go on; no link between
components is missed, and pairs within a component aren't listed.  Every link is verified on whole texts, which move
to the hub that they are compared with, many to a hub being dealt over several tasks.

A signature that very many sets of different components share (``cooled``; a passage that makes up most of many texts)
isn't compared in pairs: similar sets of it share, besides what is common there, some shingle that few of its sets have,
unless both consist of common shingles nearly alone.  So the rarest shingles of each set stand for the signature, as many
as it takes for similar sets to share one, and only sets of common shingles keep it.

Defined cases: a text with fewer than five words has one shingle, all its words; null, empty and blank texts have none
and are linked with nothing; rows with a null doc_id have no component and no links; rows with one doc_id count as one
document, linked by any of its texts; equal texts are linked; very long texts are handled a few at a time; an empty
table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from seriatim.llm.common import Staging, WordTable, keyed_broadcast, mixed, small, sums_by, text_slices, texts

WORDS = 5
THRESHOLD = 80  # percent
#: 64-bit words of a sketch at least: the parities of shingles by bucket, of which there are as many as shingles or more.
SKETCH = 8
#: Words whose hashes a task keeps at most.
CACHE_WORDS = 300_000
#: Size of a band's largest sets over its smallest, in percent.
BAND = 160
#: Enumerations with other partitions that a set tries before it takes the signature of its empty projections.
TRIES = 16
#: Signatures that a task packs at once, and those that a range's task holds before it lets go of the shared ones.
PACKED = 500_000
HELD = 8_000_000
#: Sets of one signature that are compared in one go; larger groups are split in blocks, and pairs of blocks compared.
BLOCK = 2048
#: Texts that are compared with a hub in one task.
SPOKES = 1000
#: Digests tried until no two different sets share their first 64 bits, which stand for the set from then on.
DIGESTS = 4
DISTANCE = (100 + THRESHOLD, 100 - THRESHOLD)  # sets are similar if d * 180 <= (a + b) * 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted 64-bit shingle hashes of whole texts."""

    def __init__(self) -> None:
        self.words, self.hashes = WordTable(), np.zeros(0, np.uint64)

    def __call__(self, all_texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self.words, self.hashes = WordTable(), np.zeros(0, np.uint64)
        numbered = []
        for t in all_texts:
            words = t.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and white space as the pattern has it
            numbered.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        if self.words.fresh:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, self.words.fresh), np.uint64, len(self.words.fresh))])
            self.words.fresh = []
        return [self._set(self.hashes[n]) for n in numbered]

    @staticmethod
    def _set(h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        n = min(len(h), WORDS)
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = out * GOLDEN + h[i : len(h) - n + 1 + i]
        out = np.sort(mixed(out ^ np.uint64(n)))
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def bands() -> tuple[np.ndarray, np.ndarray]:
    """First and last sizes of the bands."""
    first, last = [1], []
    while first[-1] < 1 << 40:
        last.append(max(first[-1], first[-1] * BAND // 100))
        first.append(last[-1] + 1)
    return np.array(first[:-1]), np.array(last)


FIRST, LAST = bands()
#: By band: how many shingles two similar sets may differ in at most, the parts, and the sub-parts of each.  With s
#: sub-parts, MOST differences leave two sub-parts of some part alone if parts * (s - 1) > MOST; small sets have one
#: part, large ones three sub-parts, and a sixth of the parts over since projections may be empty.
MOST = (2 * LAST * DISTANCE[1]) // DISTANCE[0]
SUBS = np.where(MOST <= 4, MOST + 2, 3)
PARTS = np.where(MOST <= 4, 1, MOST // 2 + 2 + MOST // 12)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all sets, the number of the set that each is of, and whether it is of the set's own band."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    own = np.searchsorted(FIRST, sizes[full], side="right") - 1
    up = sizes[full] * 100 // THRESHOLD > LAST[own]  # a similar set may be of the next band
    found, owners, natives = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for members, band, native in ((full, own, True), (full[up], own[up] + 1, False)):
        for subs in np.unique(SUBS[band]):
            alike = (SUBS[band] == subs) & (MOST[band] > 0)  # sets of a band without MOST are similar only if equal
            for signature, owner in _enumerated([sets[i] for i in members[alike]], band[alike], int(subs)):
                found.append(signature)
                owners.append(members[alike][owner])
                natives.append(np.full(len(owner), native))
    return np.concatenate(found), np.concatenate(owners), np.concatenate(natives)


def _enumerated(sets: list[np.ndarray], band: np.ndarray, subs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Signatures in the given bands, all with ``subs`` sub-parts a part, and the numbers of their sets."""
    todo = np.arange(len(sets))
    for turn in range(TRIES):
        if not len(todo):
            return
        parts, n = PARTS[band], np.array([len(sets[i]) for i in todo], np.int64)
        seed = mixed((band * 64 + turn).astype(np.uint64))
        first = np.concatenate([[0], np.cumsum(parts)])  # of each set's parts
        values = np.concatenate([sets[i] for i in todo])
        cell = (mixed(values ^ np.repeat(seed, n)) % np.repeat((parts * subs).astype(np.uint64), n)).astype(np.int64) + np.repeat(first[:-1] * subs, n)
        total, count = sums_by(values, cell, int(first[-1]) * subs)
        total, filled = total.reshape(-1, subs), count.reshape(-1, subs) > 0
        owner = np.repeat(np.arange(len(todo)), parts)
        part = np.arange(first[-1]) - np.repeat(first[:-1], parts)
        place = mixed(part.astype(np.uint64) * GOLDEN + np.repeat(seed, parts))
        for i, j in combinations(range(subs), 2):
            some = filled[:, i] | filled[:, j]
            yield mixed(mixed(total[some, i] + np.uint64(i + 1)) * GOLDEN + total[some, j] + np.uint64(j + 1) * place[some]), todo[owner[some]]
        # so many differences it takes to leave no filled subset of a part alone: in all sub-parts but one, or in all filled ones
        again = np.bincount(owner, weights=np.minimum(filled.sum(axis=1), subs - 1), minlength=len(todo)) <= MOST[band]
        todo, band = todo[again], band[again]
    if len(todo):
        yield mixed(band.astype(np.uint64) + np.uint64(1 << 62)), todo


def sketch(s: np.ndarray) -> np.ndarray:
    """A power of two of words; that of half the size is the two halves' exclusive or."""
    buckets = max(64 * SKETCH, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((mixed(s + np.uint64(99)) % np.uint64(buckets)).astype(np.int64), minlength=buckets) & 1).view(np.int64)


def folded(bits: list[np.ndarray]) -> np.ndarray:
    """All sketches in the size of the smallest."""
    words = min(map(len, bits))
    return np.stack([np.bitwise_xor.reduce(b.reshape(-1, words), axis=0) for b in bits]).view(np.uint64)


def _key(s: np.ndarray, turn: int) -> tuple[int, int]:
    return tuple(np.frombuffer(blake2b(s.tobytes(), digest_size=16, salt=bytes([turn])).digest(), np.int64).tolist())


def _described(turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in small(batches):
            all_texts = texts(batch)
            for part in text_slices(all_texts):
                sets = shingle(all_texts[part])
                keys = np.array([_key(s, turn) for s in sets], np.int64)
                columns = {"n": pa.array([len(s) for s in sets], pa.int64()), "ka": pa.array(keys[:, 0]), "kb": pa.array(keys[:, 1]), "bits": pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop], *columns.values()], names=["doc_id", *columns])

    return run


def _range(found: np.ndarray, ranges: int) -> np.ndarray:
    return (((found >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second, and so on: the last are nearly all 0 and take no room."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def packed(found: np.ndarray, keys: np.ndarray, native: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """Range and block of signatures: 32 bits of each within its range, in order, and which set it is of."""
    order = np.argsort(found)
    found, keys, native = found[order], keys[order], native[order]
    span = -(-(1 << 32) // ranges)  # of a range, in the upper 32 bits
    edges = np.searchsorted(_range(found, ranges), np.arange(ranges + 1))
    for r, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        if lo < hi:
            first = np.uint64(-(-(r << 32) // ranges) << 32)
            place = ((found[lo:hi] - first) >> np.uint64(span.bit_length())).astype(np.uint32)
            sets, number = np.unique(keys[lo:hi], return_inverse=True)
            block = _planes(np.diff(place, prepend=np.uint32(0))) + _planes(number * 2 + native[lo:hi]) + sets.astype("<i8").tobytes()
            yield r, np.array([hi - lo, len(sets)], "<u4").tobytes() + pa.Codec("zstd", compression_level=1).compress(block, asbytes=True)


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the range, keys of the sets, and whether of their own bands."""
    n, sets = np.frombuffer(block, "<u4", 2).tolist()
    data = np.frombuffer(pa.Codec("zstd").decompress(block[8:], 8 * n + 8 * sets, asbytes=True), np.uint8)
    place, mark = (np.ascontiguousarray(data[4 * n * i : 4 * n * (i + 1)].reshape(4, n).T).view("<u4").ravel() for i in range(2))
    return np.cumsum(place, dtype=np.uint32), data[8 * n :].view("<i8")[mark >> 1], (mark & 1).astype(bool)


def _signed(turn: int, ranges: int):
    """Blocks of the signatures of the first of a task's equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(), set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def let_go() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            for r, block in packed(*columns, ranges):
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "block": pa.array([block], pa.binary())})

        for batch in small(batches):
            all_texts = texts(batch)
            for part in text_slices(all_texts):
                new, own = [], []
                for s in shingle(all_texts[part]):
                    if len(s) and (key := _key(s, turn)[0]) not in seen:
                        seen.add(key)
                        new.append(s)
                        own.append(key)
                found, owner, native = signatures(new)
                held.append((found, np.array(own, np.int64)[owner], native))
                if sum(len(h[0]) for h in held) >= PACKED:
                    yield from let_go()
        if held:
            yield from let_go()

    return run


class SharedSignatures:
    """Of the signatures of a range, groups of different sets that share one, at least one of them in its own band.

    Groups of the same sets are told once, under a digest of the sets, with their size.  When more than ``most`` rows
    are held, those of shared signatures go out under a digest of the signature, without a size, and so do later rows of
    these signatures; so a task holds no more than that and the different signatures of its range.
    """

    def __init__(self, most: int, number: int = 0) -> None:
        self.most, self.limit, self.salt = most, most, mixed(np.array([number + 1], np.uint64))
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, place: np.ndarray, keys: np.ndarray, native: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((place, keys, native, np.zeros(len(place), bool)))
        self.rows += len(place)
        if self.rows > self.limit:
            yield from self.out(False)
            self.limit = self.rows + self.most

    def out(self, final: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.rows = [], 0
        order = np.argsort(columns[0])
        again = columns[0][order]
        again = again[1:] == again[:-1]
        several = np.zeros(len(order), bool)
        several[1:] |= again
        several[:-1] |= again
        if not final:
            self._keep([c[order[~several]] for c in columns])
        place, keys, native, told = (c[order[several]] for c in columns)
        order = np.lexsort((~told, keys, place))
        place, keys, native, told = place[order], keys[order], native[order], told[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (keys[1:] != keys[:-1])
        place, keys, native, told = place[new], keys[new], native[new], told[new]
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(place)))
        group = np.repeat(np.arange(len(starts)), size)
        shared, open_, own = size > 1, np.logical_or.reduceat(told, starts) if len(starts) else told, np.logical_or.reduceat(native, starts) if len(starts) else native
        if not final:
            marks = np.zeros(len(place), bool)
            marks[starts] = True
            kept = np.where((shared | open_)[group], marks, True)
            self._keep([place[kept], keys[kept], native[kept], (shared | open_)[group[kept]]])
            open_ = shared
        digest = mixed(place[starts].astype(np.uint64) * GOLDEN ^ self.salt).view(np.int64) if len(starts) else np.zeros(0, np.int64)
        members = np.add.reduceat(mixed(keys.view(np.uint64) * np.uint64(2) ^ native), starts) if len(starts) else np.zeros(0, np.uint64)
        digest = np.where(open_, digest, mixed(members).view(np.int64))
        first = np.zeros(len(starts), bool)
        first[np.unique(digest, return_index=True)[1]] = True
        out = (shared & first & (own | open_))[group]
        yield pa.RecordBatch.from_arrays([pa.array(digest[group[out]]), pa.array(keys[out]), pa.array(native[out]), pa.array(size[group[out]].astype(np.int64), mask=open_[group[out]])], names=["gh", "node", "native", "size"])

    def _keep(self, columns: list[np.ndarray]) -> None:
        self.held.append(tuple(columns))
        self.rows += len(columns[0])


def _shared(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, at = SharedSignatures(most), None
        for batch in batches:
            for r, block in zip(batch.column("range").to_pylist(), batch.column("block"), strict=True):
                if r != at:
                    yield from groups.out(True)
                    groups, at = SharedSignatures(most, r), r
                yield from groups.add(*unpacked(block.as_py()))
        yield from groups.out(True)

    return run


def _same(turn: int):
    """a, b of texts (role 1) similar to their hub's (role 0), which comes first; texts that aren't of the set looked for (a doc_id may have several) are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, hub, at = Shingler(), None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for a, spot, role, node, s in zip(*(part.column(c).to_pylist() for c in ("a", "part", "role", "node")), shingle(texts(part)), strict=True):
                    if at != (a, spot):
                        hub, at = None, (a, spot)
                    if _key(s, turn)[0] != node:
                        continue
                    if role == 0:
                        hub = s
                    elif hub is not None:
                        both = len(np.intersect1d(hub, s, assume_unique=True))
                        if both and 100 * both >= THRESHOLD * (len(hub) + len(s) - both):
                            out.append((a, node))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _shingles(turn: int):
    """node and its shingles, of texts (node, text) that have the node's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in small(batches):
            nodes, all_texts = batch.column("node").to_pylist(), texts(batch)
            for part in text_slices(all_texts):
                own = [(n, s) for n, s in zip(nodes[part], shingle(all_texts[part]), strict=True) if _key(s, turn)[0] == n]
                if own:
                    sets = [s for _, s in own]
                    yield pa.RecordBatch.from_pydict({"node": np.repeat(np.array([n for n, _ in own], np.int64), [len(s) for s in sets]), "shingle": np.concatenate(sets).view(np.int64)})

    return run


def _fits(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sketches and sizes allow sets to be similar, and the share of their sizes in which the sketches differ."""
    apart, total = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1, dtype=np.int64), n_a + n_b
    return (apart * DISTANCE[0] <= total * DISTANCE[1]) & (np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * THRESHOLD), apart / total


def allowed(a: str, b: str) -> Column:
    """``_fits`` of two structs of n and bits."""
    xor = lambda x, y: x.bitwiseXOR(y)
    n, m, p, q = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.bits"), F.col(f"{b}.bits")
    words = F.least(F.size(p), F.size(q))

    def half(x: Column) -> Column:
        """Sizes that may be similar have sketches of one size or of twice that."""
        return F.when(F.size(x) > words, F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), xor)).otherwise(x)

    apart = F.aggregate(F.zip_with(half(p), half(q), xor), F.lit(0), lambda acc, x: acc + F.bit_count(x))
    return F.when(F.least(n, m) * 100 >= F.greatest(n, m) * THRESHOLD, apart * DISTANCE[0] <= (n + m) * DISTANCE[1]).otherwise(False)


def _near(every: bool):
    """Pairs of one group (and pair of blocks) and of different components that sketches allow: all, or each set with its nearest.  One of a pair has the signature in its own band."""

    def pairs_of(nodes: np.ndarray, comps: np.ndarray, n: np.ndarray, native: np.ndarray, side: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int]]:
        _, inverse, count = np.unique(comps, return_inverse=True, return_counts=True)
        rest = np.flatnonzero(inverse != count.argmax())
        step = max(1, (1 << 21) // (len(nodes) * bits.shape[1]))
        for lo in range(0, len(rest), step):
            r = rest[lo : lo + step]
            fits, share = _fits(bits[r][:, None, :], bits[None, :, :], n[r][:, None], n[None, :])
            fits &= (comps[r][:, None] != comps[None, :]) & (native[r][:, None] | native[None, :]) & ((side[r][:, None] | side[None, :]) == 3)
            if every:
                i, j = np.nonzero(fits)
            else:
                j = np.where(fits, share, 9.0).argmin(axis=1)
                i = np.flatnonzero(fits.any(axis=1))
                j = j[i]
            yield from zip(nodes[r[i]].tolist(), nodes[j].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        sent: set[tuple[int, int]] = set()

        def groups(final: bool) -> pa.RecordBatch:
            *cols, bits = zip(*held, strict=True)
            cols, bits = [np.concatenate(c) for c in cols], [x for b in bits for x in b]
            held.clear()
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            edges = [0, *cut.tolist(), len(cols[0])]
            if not final:
                held.append((*(c[edges[-2] :] for c in cols), bits[edges[-2] :]))
                edges.pop()
            pairs: set[tuple[int, int]] = set()
            for lo, hi in zip(edges, edges[1:], strict=False):
                pairs.update((min(a, b), max(a, b)) for a, b in pairs_of(*(c[lo:hi] for c in cols[2:]), folded(bits[lo:hi])))
            pairs -= sent
            if len(sent) > 500_000:
                sent.clear()
            sent.update(pairs)
            return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        for batch in batches:
            if batch.num_rows:
                column = batch.column("bits")
                bits = np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])
                held.append((*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("gh", "pair", "node", "mark", "n", "native", "side")), bits))
                yield groups(False)
        if held:
            yield groups(True)

    return run


def components(edges: DataFrame, stage: Staging) -> DataFrame:
    """node, comp (the smallest node that links reach) of all nodes of ``edges`` (a, b), by large-star and small-star steps."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        both = stage(edges.union(edges.select("b", "a")), "links")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        edges = stage(both.filter("b > a").withColumnRenamed("b", "v").join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "links")
        least = stage(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = stage(moved.filter("a <> b").distinct(), "links")
        links, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
        centres = edges.select(F.col("b").alias("a")).distinct()
        if links == nodes and edges.join(centres, "a", "left_semi").isEmpty():  # stars only
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select("b", "b").distinct())


class _Links:
    """Verified links between sets, and the components that they make."""

    def __init__(self, documents: DataFrame, sets: DataFrame, turn: int, stage: Staging) -> None:
        self.documents, self.sets, self.turn, self.stage = documents, sets, turn, stage
        self.labels: DataFrame | None = None
        self.tried: DataFrame | None = None

    def add(self, pairs: DataFrame) -> bool:
        """Verifies ``pairs`` (a: the hub, b) that weren't before, on their texts; true if there are new links."""
        pairs = pairs.select("a", "b").distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, [F.least("a", "b") == F.col("low"), F.greatest("a", "b") == F.col("high")], "left_anti")
        pairs = self.stage(pairs, "candidates")
        tried = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        self.tried = tried if self.tried is None else self.tried.union(tried)
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("parts"))
        dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
        roles = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("node")).union(dealt.select("a", "part", F.lit(0), "a").distinct())
        roles = self.stage(roles.join(self.sets.select(F.col("ka").alias("node"), "rep"), "node"), "roles")
        if not (rows := roles.count()):
            return False
        t = self.documents.join(keyed_broadcast(roles, rows), F.col("doc_id") == F.col("rep")).select("a", "part", "role", "node", "text")
        found = t.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(_same(self.turn), "a long, b long")
        found = self.stage(found, "verified")
        if found.isEmpty():
            return False
        self.join(found)
        return True

    def join(self, links: DataFrame) -> None:
        known = [] if self.labels is None else [self.labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))]
        self.labels = components(reduce(DataFrame.union, [links.select("a", "b"), *known]), self.stage)

    def hubs(self, groups: DataFrame) -> DataFrame:
        """a, b: each set (b) with the hub that it shares most groups with, where sketches allow the two."""
        weight = groups.groupBy("node").agg(F.count("*").alias("weight"))
        top = groups.join(weight, "node").groupBy("gh").agg(F.max(F.struct("weight", "node")).alias("top"))
        edges = groups.select("gh", "node").join(top.select("gh", F.col("top.node").alias("hub")), "gh").filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("shared"))
        best = edges.groupBy("node").agg(F.max(F.struct("shared", "hub")).alias("best")).select(F.col("best.hub").alias("a"), F.col("node").alias("b"))
        return self.fitting(best)

    def fitting(self, pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(self.sets.select(F.col("ka").alias(end), F.struct("n", "bits").alias(f"of_{end}")), end)
        return pairs.filter(allowed("of_a", "of_b")).select("a", "b")

    def marked(self, groups: DataFrame) -> DataFrame:
        """``groups`` with each node's component as mark."""
        if self.labels is None:
            return groups.withColumn("mark", F.col("node"))
        return groups.join(self.labels, "node", "left").withColumn("mark", F.coalesce("comp", "node")).drop("comp")

    def cooled(self, groups: DataFrame) -> DataFrame:
        """``groups`` in which none has more than BLOCK sets outside its largest component, but for sets of common shingles nearly alone.

        In what hot groups hold together, a shingle is common if more than BLOCK sets have it.  Similar sets share 80 % of
        either's shingles; so a set with c common ones of n shares with any similar one at least 0.8 n - c others, or one
        if that is less and the two aren't similar by common ones alone, for which both need c >= 0.8 n.
        """
        by_mark = self.marked(groups).groupBy("gh", "mark").agg(F.count("*").alias("k"))
        hot = self.stage(by_mark.groupBy("gh").agg((F.sum("k") - F.max("k")).alias("rest")).filter(F.col("rest") > BLOCK).select("gh"), "hot")
        if not (many := hot.count()):
            return groups
        hot = keyed_broadcast(hot, many)
        heated = groups.join(hot, "gh", "left_semi")
        nodes = self.stage(heated.select("node").distinct().join(self.sets.select(F.col("ka").alias("node"), "rep", "n"), "node"), "hot-sets")
        t = self.documents.join(keyed_broadcast(nodes, nodes.count()), F.col("doc_id") == F.col("rep")).select("node", "text")
        own = self.stage(t.mapInArrow(_shingles(self.turn), "node long, shingle long").distinct(), "hot-shingles")  # a doc_id may have its text twice
        seen = self.stage(own.groupBy("shingle").agg(F.count("*").alias("f")), "shingle-counts")
        common = seen.filter(F.col("f") > BLOCK).select("shingle")
        rare = own.join(keyed_broadcast(common, common.count()), "shingle", "left_anti").join(seen.filter(F.col("f") <= BLOCK), "shingle")
        rare = rare.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("rare"))  # a text's own
        d = nodes.join(rare, "node", "left").withColumn("r", F.coalesce(F.size("rare"), F.lit(0)))
        need = F.greatest(F.lit(1), F.ceil(F.col("n") * THRESHOLD / 100) - (F.col("n") - F.col("r"))).cast("int")
        d = self.stage(d.select("node", ((F.col("n") - F.col("r")) * 100 >= F.col("n") * THRESHOLD).alias("core"), F.slice("rare", F.lit(1), F.greatest(F.col("r") - need + 1, F.lit(0))).alias("prefix")), "prefixes")
        prefixes = d.filter("prefix is not null").select(F.explode("prefix").alias("p"), "node").select(F.xxhash64(F.lit("rare"), "p.shingle").alias("gh"), "node", F.lit(True).alias("native"))
        core = heated.join(d.filter("core").select("node"), "node", "left_semi").select("gh", "node", "native")
        new = self.stage(prefixes.unionByName(core), "cooled")
        sizes = new.groupBy("gh").agg(F.count("*").alias("size")).filter("size > 1")
        return self.stage(groups.join(hot, "gh", "left_anti").select("gh", "node", "native", "size").unionByName(new.join(sizes, "gh").select("gh", "node", "native", "size")), "groups")

    def apart(self, groups: DataFrame, every: bool) -> DataFrame:
        """a, b of groups (gh, node, native, size): pairs of different components that sketches allow."""
        d = self.stage(self.marked(groups), "marked")
        several = d.groupBy("gh").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.max("native").alias("own")).filter("low <> high and own")
        d = d.join(several.select("gh"), "gh").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        d = d.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.least("own", "other").cast("long") * F.lit(1 << 31) + F.greatest("own", "other")
        side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("long")
        d = d.select("gh", pair.alias("pair"), "node", "mark", "native", side.alias("side")).join(self.sets.select(F.col("ka").alias("node"), "n", "bits"), "node")
        return d.repartition("gh", "pair").sortWithinPartitions("gh", "pair").mapInArrow(_near(every), "a long, b long")


def link(documents: DataFrame) -> DataFrame:
    """doc_id, n, component of every document."""
    spark = documents.sparkSession
    stage = Staging(spark, "ngram-join")
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for turn in range(DIGESTS):
        info = stage(d.mapInArrow(_described(turn), "doc_id long, n long, ka long, kb long, bits array<long>"), "documents")
        filled = info.filter("n > 0 and doc_id is not null")
        sets = stage(filled.groupBy("ka").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), (F.min("kb") == F.max("kb")).alias("one"), F.max("bits").alias("bits")), "sets")
        if sets.filter("not one").isEmpty():
            break
    else:
        raise ValueError("different sets share the first 64 bits of every digest")
    links = _Links(d, sets, turn, stage)

    several = info.filter("doc_id is not null").groupBy("doc_id").agg(F.min("ka").alias("low"), F.max("ka").alias("high")).filter("low <> high").select("doc_id")
    several = stage(several, "several-texts")  # documents with rows of different texts
    repeated = not several.isEmpty()
    if repeated:
        own = stage(filled.join(several, "doc_id").select("doc_id", "ka").distinct(), "their-sets")
        links.join(own.join(own.groupBy("doc_id").agg(F.min("ka").alias("a")), "doc_id").select("a", F.col("ka").alias("b")))

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = d.filter("doc_id is not null").mapInArrow(_signed(turn, ranges), "range int, block binary").repartitionById(ranges, "range")
    groups = blocks.mapInArrow(_shared(HELD), "gh long, node long, native boolean, size long")
    groups = stage(groups.groupBy("gh", "node").agg(F.max("native").alias("native"), F.max("size").alias("size")), "groups")
    if not groups.filter("size is null").isEmpty():
        sizes = groups.filter("size is null").groupBy("gh").agg(F.count("*").alias("counted"))
        groups = stage(groups.join(sizes, "gh", "left").withColumn("size", F.coalesce("counted", "size")).drop("counted"), "groups")

    links.add(links.hubs(groups))
    groups = links.cooled(groups)
    links.add(links.apart(groups, every=False))  # nearest by sketch: most links between what is left, not all
    links.add(links.apart(groups, every=True))
    found = sets.select("ka", F.col("rep").alias("component"))
    if links.labels is not None:
        by_comp = links.labels.join(sets.select(F.col("ka").alias("node"), "rep"), "node").select("node", "comp", "rep")
        least = by_comp.groupBy("comp").agg(F.min("rep").alias("least"))
        named = by_comp.join(least, "comp").select(F.col("node").alias("ka"), "least")
        found = found.join(named, "ka", "left").select("ka", F.coalesce("least", "component").alias("component"))
    members = filled.select("doc_id", "n", "ka").join(stage(found, "named"), "ka").select("doc_id", "n", "component")
    rest = info.filter("n = 0 or doc_id is null").select("doc_id", "n")
    if not repeated:
        rest = rest.withColumn("component", F.col("doc_id"))
    else:
        theirs = members.join(several, "doc_id").groupBy("doc_id").agg(F.min("component").alias("component"))
        rest = rest.join(theirs, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    out = stage(members.unionByName(rest), "classes")
    stage.clear("classes")
    return out


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return link(documents).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def ordered(field: StructField) -> Column:
    """The column, or its JSON if it holds a map, which has no order."""
    return F.to_json(F.struct(field.name)) if "map" in re.findall(r"\w+", field.dataType.simpleString()) else F.col(field.name)


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` without those that aren't the first (by doc_id) of their component; of different rows with one doc_id the least stays, by its columns' values (a map's as JSON) in order."""
    stage = Staging(documents.sparkSession, "keep-one")
    found = classes(documents)
    gone = stage(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = documents.join(keyed_broadcast(gone, gone.count()), "doc_id", "left_anti").select(*documents.columns)
    twice = stage(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id"), "repeated")
    n = twice.count()
    if not n:
        return kept
    hint = keyed_broadcast(twice, n)
    least = kept.join(hint, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*documents.columns), F.struct(*map(ordered, documents.schema))).alias("row"))
    return kept.join(hint, "doc_id", "left_anti").select(*documents.columns).unionByName(least.select("row.*"))
