"""Toxicity: a convolutional text classifier trained in numpy.

A word (a run of letters, lower-cased) is embedded as the sum of the hashed embeddings of itself and of its character
4- and 5-grams.  Filters of several widths run over the words, each filter's maximum over the document is pooled, and
a logistic output gives the score.  At scoring time filters and embeddings are multiplied out into one table, so a
window is a sum of table rows.  The score is calibrated so that 0.7 is the cut that does best on a validation part of
all labelled rows; cuts by language are calibrated in the same way for callers that know a document's language.

All learnable labelled rows are learned from, with their whole texts.  Where they are few, the driver trains on them.
Where they are more, that gives the first weights only: then every row goes, in each of ROUNDS rounds, through the task
of its shard, which starts from the weights of all shards so far, and the changes of the shards are averaged by blocks of
embeddings.  The rows kept for calibration, a fifth, are scored by tasks, and cuts come from exact counts of them.

Inputs of a score are the text alone, whole and however long; a document's windows never reach into another's words, so
a score doesn't depend on order or partitions.  Defined cases: a null, empty or wordless text gets the score of a
document without words; equal texts get equal scores; a score at the cut counts as toxic; repeated rows stay; other
columns, whatever their names, are left out by ``score`` and kept by ``reject``; without labels of both classes every
document gets one score below the cut; an empty table gives no rows.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriatim.llm.common import LETTERS, WordTable, flat, held_out, keyed_broadcast, learnable, ngram_ids, slices, small, staged, text_slices, texts, unused

BUCKETS = 1 << 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
GRAMS = (4, 5)
#: Labelled documents of each class that the driver trains on at most: those with the smallest hashes of their ids.
SAMPLE_PER_CLASS = 2500
#: Letters of training text a class at most.  Where a class has more, its longest documents give evenly spaced pieces
#: of themselves, as long as fits; no document is left out.
SAMPLE_LETTERS = 10_000_000
PIECES = 64
EPOCHS = 6
#: Passes of all labelled rows through their shards, rows of a shard at least, and shards at most (a shard streams its rows).
ROUNDS = 2
ROWS_OF_A_SHARD = 2500
SHARDS = 64
#: Documents and words of a step, and documents and letters that a shard holds as Python objects at once.
BATCH = 32
WORDS_OF_A_BATCH = 100_000
DOCS_OF_A_CHUNK = 512
LETTERS_OF_A_CHUNK = 1_000_000
#: Blocks of embeddings that are averaged apart.
BLOCKS = 16
#: Toxic documents that the part kept for calibration needs; with fewer all labelled rows calibrate.
LEAST_HELD = 20
PREDICT_AT = 0.7
CACHE_WORDS = 150_000
#: Words whose n-grams are found at once, and letters of text that are scored at once.
WORDS_AT_ONCE = 50_000
FRESH_AT_ONCE = 8_000
LETTERS_AT_ONCE = 300_000


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x (sum of widths * FILTERS), float32
    bias: np.ndarray
    weight: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def _windows(rows: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """For each width, the filters' values at every position; a window that starts on a document's closing blanks, and so could reach into the next document, has none (minus infinity).

    rows: a row for each position of all documents, with the products of all widths; starts: of the documents, each of which ends in max(WIDTHS) - 1 blank positions.
    """
    pad = max(WIDTHS) - 1
    blanks = (np.append(starts[1:], len(rows))[:, None] - np.arange(1, pad + 1)).ravel()
    column = 0
    for w in WIDTHS:
        z = rows[:, column : column + FILTERS].copy()
        for o in range(1, w):
            z[:-o] += rows[o:, column + o * FILTERS : column + (o + 1) * FILTERS]
        z[blanks] = -np.inf
        yield z
        column += w * FILTERS


def _pooled(rows: np.ndarray, starts: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.maximum(np.concatenate([np.maximum.reduceat(z, starts, axis=0) for z in _windows(rows, starts)], axis=1) + bias, 0)


def _laid_out(numbers: np.ndarray, ends: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with max(WIDTHS) - 1 blank positions after each document, and where documents start; a document without words is one more blank."""
    pad = max(WIDTHS) - 1
    n = len(ends) - 1
    size = np.maximum(np.diff(ends), 1) + pad
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    out = np.full(int(size.sum()), blank, np.int64)
    if len(numbers):
        out[np.repeat(starts - ends[:-1], np.diff(ends)) + np.arange(len(numbers))] = numbers
    return out, starts if n else np.zeros(0, np.int64)


class Scorer:
    """A task's words and their rows of products; row 0 is the blank."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.words, self.table = WordTable(), np.zeros((1 << 12, self.model.table.shape[1]), np.float32)

    def logits(self, documents: list[list[str]]) -> np.ndarray:
        """Scores before calibration."""
        if len(self.words) > CACHE_WORDS:
            self.clear()
        m, first = self.model, len(self.words) + 1
        found, ends = flat(documents)
        numbers = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found)) + 1
        fresh, self.words.fresh = self.words.fresh, []
        if first + len(fresh) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), first + len(fresh)), self.table.shape[1]), np.float32)
            grown[:first] = self.table[:first]
            self.table = grown
        for part in slices(len(fresh), FRESH_AT_ONCE):
            ids, starts = ngram_ids(fresh[part], GRAMS, BUCKETS, whole=True)
            share = 1 / np.sqrt(np.diff(starts))
            self.table[first + part.start : first + part.stop] = np.add.reduceat(m.table[ids], starts[:-1], axis=0) * share[:, None].astype(np.float32)
        at, starts = _laid_out(numbers, ends, 0)
        return (_pooled(self.table[at], starts, m.bias) * m.weight).sum(axis=1) + m.out_bias  # row by row: a score doesn't depend on its neighbours


def calibrated(model: Model, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30)))


def _marked(labels: DataFrame) -> DataFrame:
    """doc_id, toxic, h of all learnable labelled ids; one that is labelled more than once counts as toxic if any of its labels does."""
    marked = labels.filter(F.col("toxic").isNotNull() & learnable()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return marked.filter(F.col("toxic").isin(0, 1)).withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id"))


def _labelled(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """h, doc_id, lang, text, toxic of the documents with these ids."""
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.select("doc_id", lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("h", "doc_id", "lang", "text", "toxic")


def training_sample(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """lang, text, toxic of a bounded number of learnable labelled documents of each class."""
    return _sample(documents, _marked(labels), per_class)


def _sample(documents: DataFrame, marked: DataFrame, per_class: int) -> DataFrame:
    sides = [marked.filter(F.col("toxic") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    return _labelled(documents, F.broadcast(staged(sides[0].unionByName(sides[1]), "toxicity-sample")))


def _caps(lengths: list[tuple[int, int, int]], letters: int) -> dict[int, int | None]:
    """The length for each class to which its longer documents are cut so that all of them fit ``letters``; None where all fit whole.  ``lengths``: class, length, number."""
    out: dict[int, int | None] = {}
    for y in (0, 1):
        own = sorted((n, c) for t, n, c in lengths if t == y)
        left, count = letters, sum(c for _, c in own)
        out[y] = None
        for n, c in own:
            if n * count > left:
                out[y] = left // count
                break
            left, count = left - n * c, count - c
    return out


def _pieces(cap: int) -> Column:
    """``text``, or PIECES pieces of ``cap`` letters in all from a longer one, the first from its start and the last from its end."""
    n = max(1, min(PIECES, cap))
    size, length = cap // n, F.length("text").cast("long")
    start = lambda i: F.floor(i * (length - size) / max(n - 1, 1)).cast("int") + 1
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr("text", start(i), F.lit(size)))
    return F.when(length <= cap, F.col("text")).otherwise(F.array_join(parts, "\n"))


def _lengths(sample: DataFrame) -> list[tuple[int, int, int]]:
    return [tuple(r) for r in sample.groupBy("toxic", F.length("text")).count().collect()]


def _gather(sample: DataFrame, caps: dict[int, int | None] | None = None) -> list[tuple[str | None, list[str], int]]:
    out, same = [], {}
    for y, cap in (caps or _caps(_lengths(sample), SAMPLE_LETTERS)).items():
        if cap is not None:
            sample = sample.withColumn("text", F.when(F.col("toxic") == y, _pieces(cap)).otherwise(F.col("text")))
    for r in sample.orderBy("h", "doc_id", F.xxhash64("text")).toLocalIterator():
        out.append((r["lang"], [same.setdefault(w, w) for w in words_of(r["text"])], r["toxic"]))  # a word is held once
    return out


def _summed(cells: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different cells, and the sum of each one's rows of ``values``."""
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    return cells[starts], np.add.reduceat(values[order], starts, axis=0)


def _numbered(documents: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each document's words as numbers from 1, the n-grams of all words in a row, and where each word's start."""
    words = WordTable()
    numbered = [np.fromiter(map(words.__getitem__, w), np.int64, len(w)) + 1 for w in documents]
    vocabulary = list(words)
    parts = [ngram_ids(vocabulary[part], GRAMS, BUCKETS, whole=True) for part in slices(len(vocabulary), WORDS_AT_ONCE)]
    ids = np.concatenate([np.zeros(0, np.int32), *(i.astype(np.int32) for i, _ in parts)])
    starts = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(e) for _, e in parts)]))]).astype(np.int64)
    return numbered, ids, starts


def _balance(y: np.ndarray, toxic_share: float) -> np.ndarray:
    """Weights by which both classes count as much."""
    return np.where(y == 1, 0.5 / max(toxic_share, 1e-6), 0.5 / max(1 - toxic_share, 1e-6)).astype(np.float32)


class Network:
    """Weights in training, and what their steps are sized by (Adam; embeddings by the sum of squares)."""

    def __init__(self, rng: np.random.Generator) -> None:
        width, pooled = sum(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS
        self.emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.params = {"filt": rng.normal(0, 0.3, (DIM, width)).astype(np.float32), "bias": np.zeros(pooled, np.float32), "weight": rng.normal(0, 0.3, pooled).astype(np.float32)}
        self.out_bias = np.float32(0)
        self.first = {k: np.zeros_like(v) for k, v in self.params.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.params.items()}
        self.squares = np.zeros_like(self.emb)
        self.step = 0

    def model(self) -> Model:
        return Model((self.emb @ self.params["filt"]).astype(np.float32), self.params["bias"].astype(np.float64), self.params["weight"].astype(np.float64), float(self.out_bias))

    def fit(self, documents: tuple[list[np.ndarray], np.ndarray, np.ndarray], y: np.ndarray, balance: np.ndarray, picks: Iterator[np.ndarray]) -> None:
        """A step for each of ``picks``, the places of its documents among all (as of ``_numbered``)."""
        numbered, ids, starts = documents
        share = 1 / np.sqrt(np.maximum(np.diff(starts), 1))
        emb, params, first, second = self.emb, self.params, self.first, self.second
        filt, bias, weight = params["filt"], params["bias"], params["weight"]
        owner_filter = np.concatenate([np.tile(np.arange(k * FILTERS, (k + 1) * FILTERS), w) for k, w in enumerate(WIDTHS)])  # of each column
        offset = np.concatenate([np.repeat(np.arange(w), FILTERS) for w in WIDTHS])
        for pick in picks:
            used, inverse = np.unique(np.concatenate([numbered[i] for i in pick] or [np.zeros(0, np.int64)]), return_inverse=True)
            ends = np.concatenate([[0], np.cumsum([len(numbered[i]) for i in pick])]).astype(np.int64)
            count = np.diff(starts)[used - 1]
            own = np.repeat(np.arange(len(used)), count)
            grams = ids[np.repeat(starts[used - 1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())] if len(used) else np.zeros(0, np.int64)
            vectors = np.zeros((len(used) + 1, DIM), np.float32)
            if len(used):
                vectors[1:] = np.add.reduceat(emb[grams], np.concatenate([[0], np.cumsum(count)[:-1]]), axis=0) * share[used - 1, None]
            at, at_starts = _laid_out(inverse.astype(np.int64) + 1, ends, 0)
            products = vectors @ filt
            rows_at = products[at]
            at_ends = np.append(at_starts[1:], len(at))
            feats, arg = [], []
            for z in _windows(rows_at, at_starts):
                feats.append(np.maximum.reduceat(z, at_starts, axis=0))
                arg.append(np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(at_starts, at_ends, strict=True)]))
            pooled = np.maximum(np.concatenate(feats, axis=1) + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ weight + self.out_bias, -30, 30)))
            err = (p - y[pick]) * balance[pick] / len(pick)
            grad = {"weight": pooled.T @ err, "bias": None, "filt": None}
            back = np.outer(err, weight) * (pooled > 0)
            grad["bias"] = back.sum(axis=0)
            where = at[np.concatenate(arg, axis=1)[:, owner_filter] + offset]  # documents x columns: the words of the windows that won
            g = back[:, owner_filter].astype(np.float32)
            grad["filt"] = np.einsum("dc,dck->kc", g, vectors[where])
            words_hit, sums_hit = _summed(where.ravel(), (g[:, :, None] * filt.T).reshape(-1, DIM))
            into = np.zeros_like(vectors)
            into[words_hit] = sums_hit
            self.step += 1
            rate = 0.01 * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
            for k in ("filt", "bias", "weight"):
                first[k] += 0.1 * (grad[k] - first[k])
                second[k] += 0.001 * (grad[k] ** 2 - second[k])
                params[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
            self.out_bias -= np.float32(0.01) * err.sum()
            into[0] = 0
            touched = np.flatnonzero(np.abs(into[1:]).sum(axis=1))
            if len(touched):
                keep = np.isin(own, touched)
                g_rows, where = (into[1:] * share[used - 1, None])[own[keep]], grams[keep]
                cells, g_sum = _summed(where, g_rows)
                self.squares[cells] += g_sum**2
                emb[cells] -= 0.1 * g_sum / (np.sqrt(self.squares[cells]) + 1e-6)

    def dense(self) -> np.ndarray:
        """All but the embeddings, in a row."""
        return np.concatenate([[self.step, self.out_bias], *(d[k].ravel() for d in (self.params, self.first, self.second) for k in ("filt", "bias", "weight"))]).astype(np.float64)

    def set_dense(self, row: np.ndarray) -> None:
        self.step, self.out_bias, at = float(row[0]), np.float32(row[1]), 2
        for d in (self.params, self.first, self.second):
            for k in ("filt", "bias", "weight"):
                d[k][...] = row[at : at + d[k].size].reshape(d[k].shape)
                at += d[k].size


def _learned(rows: list[tuple[str | None, list[str], int]], epochs: int, seed: int) -> Network | None:
    """A network trained on these rows; None where they aren't of both classes."""
    y = np.array([r[2] for r in rows], np.float32)
    if not y.any() or y.all():
        return None
    rng = np.random.default_rng(seed)
    documents, network = _numbered([w for _, w, _ in rows]), Network(rng)
    balance = _balance(y, y.mean())
    for _ in range(min(max(epochs, -(-240 * BATCH // len(rows))), 40)):
        order = rng.permutation(len(rows))
        network.fit(documents, y, balance, (order[lo : lo + BATCH] for lo in range(0, len(order), BATCH)))
    return network


def _prior(rows: int, toxic: int) -> Model:
    """Without rows of both classes to learn from: one score for all, below the cut."""
    prior, width = toxic / rows if rows else 0.0, sum(WIDTHS) * FILTERS
    return Model(np.zeros((BUCKETS, width), np.float32), np.zeros(len(WIDTHS) * FILTERS), np.zeros(len(WIDTHS) * FILTERS), float(np.log((prior * 0.5 + 1e-3) / (1 - prior * 0.5))))


def train(rows: list[tuple[str | None, list[str], int]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on weighted log loss; every fifth document is kept for calibration, if that gives enough toxic ones."""
    kept = [i % 5 == 4 for i in range(len(rows))]
    network = _learned([r for r, k in zip(rows, kept, strict=True) if not k], epochs, seed)
    if network is None:
        return _prior(len(rows), sum(y for _, _, y in rows))
    held = [r for r, k in zip(rows, kept, strict=True) if k]
    return calibrate(network.model(), held if sum(y for _, _, y in held) >= LEAST_HELD else rows)


def _chunks(rows: Iterator[tuple[str, int]]) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Words and classes of few documents and letters at a time."""
    words, y, letters = [], [], 0
    for text, toxic in rows:
        words.append(words_of(text))
        y.append(toxic)
        letters += len(text)
        if len(y) == DOCS_OF_A_CHUNK or letters >= LETTERS_OF_A_CHUNK:
            yield words, y
            words, y, letters = [], [], 0
    if y:
        yield words, y


def _picks(sizes: list[int]) -> Iterator[np.ndarray]:
    """Steps in the documents' order, of so many documents and words at most, or one document that has more."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo == BATCH or held + n > WORDS_OF_A_BATCH):
            yield np.arange(lo, i)
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield np.arange(lo, len(sizes))


_CHANGES = "block int, shard int, cells binary, changes binary"


def _mean_changes(pieces: pa.Table) -> pa.Table:
    """A block's mean changes: of an embedding over the shards that moved it, of the rest over all."""
    block, order = pieces.column("block")[0].as_py(), np.argsort(pieces.column("shard").to_numpy())
    own = [(np.frombuffer(c.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32 if block >= 0 else np.float64)) for c, v in ((pieces.column("cells")[int(i)], pieces.column("changes")[int(i)]) for i in order)]
    if block < 0:
        cells, mean = np.zeros(0, np.int32), np.mean([v for _, v in own], axis=0)
    else:
        total, count = np.zeros((BUCKETS // BLOCKS, 2 * DIM)), np.zeros(BUCKETS // BLOCKS)
        base = block * (BUCKETS // BLOCKS)
        for c, v in own:
            total[c - base] += v.reshape(-1, 2 * DIM)
            count[c - base] += 1
        at = np.flatnonzero(count)
        cells, mean = (at + base).astype(np.int32), (total[at] / count[at, None]).astype(np.float32)
    return pa.table([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([cells.tobytes()]), pa.array([mean.tobytes()])], names=["block", "shard", "cells", "changes"])


def _round(network: Network, rows: DataFrame, shards: int, toxic_share: float, number: int) -> None:
    """Every row goes through the network of its shard once, in an order of its own each round; then ``network`` has the mean of their changes."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for b in small(batches, DOCS_OF_A_CHUNK) for r in zip(b.column("shard").to_pylist(), texts(b), b.column("toxic").to_pylist(), strict=True))
        for shard, own in groupby(found, key=lambda r: r[0]):
            net = copy.deepcopy(shared.value)
            for words, y in _chunks((t, y) for _, t, y in own):
                y = np.array(y, np.float32)
                net.fit(_numbered(words), y, _balance(y, toxic_share), _picks([len(w) for w in words]))
            was, size = shared.value, BUCKETS // BLOCKS
            pieces = [(-1, np.zeros(0, np.int32), net.dense() - was.dense())]
            moved = np.flatnonzero((net.squares != was.squares).any(axis=1)).astype(np.int32)
            changes = np.concatenate([net.emb[moved] - was.emb[moved], net.squares[moved] - was.squares[moved]], axis=1)
            pieces += [(b, moved[moved // size == b], changes[moved // size == b]) for b in range(BLOCKS)]
            for block, cells, values in pieces:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([cells.tobytes()]), pa.array([values.tobytes()])], names=["block", "shard", "cells", "changes"])

    order = F.xxhash64(F.lit(number), "doc_id")
    dealt = rows.withColumn("order", order).repartition(shards, "shard").sortWithinPartitions("shard", "order", "doc_id", F.xxhash64("text")).select("shard", "text", "toxic")
    for r in dealt.mapInArrow(run, _CHANGES).groupBy("block").applyInArrow(_mean_changes, _CHANGES).collect():
        if r["block"] < 0:
            network.set_dense(network.dense() + np.frombuffer(r["changes"], np.float64))
        else:
            cells, values = np.frombuffer(r["cells"], np.int32), np.frombuffer(r["changes"], np.float32).reshape(-1, 2 * DIM)
            network.emb[cells] += values[:, :DIM]
            network.squares[cells] += values[:, DIM:]
    shared.unpersist()


def calibrate(model: Model, rows: list[tuple[str | None, list[str], int]]) -> Model:
    """Puts the best cut at PREDICT_AT, and finds each language's own cut where the rows have enough of both classes."""
    scorer = Scorer(model)
    z = [scorer.logits([w for _, w, _ in rows[part]]) for part in slices(len(rows), 64)]
    z, y = np.concatenate(z), np.array([r[2] for r in rows])
    cut = _best_cut(z, y)
    above, below = z[y == 1], z[y == 0]
    _scaled(model, cut, float(np.median(above)) if len(above) else None, float(np.median(below)) if len(below) else None)
    langs = np.array([r[0] or "" for r in rows])
    for lang in sorted(set(langs) - {""}):
        own = langs == lang
        if min(y[own].sum(), (1 - y[own]).sum()) >= 20:
            model.cuts[lang] = float(calibrated(model, np.array([_best_cut(z[own], y[own])]))[0])
    return model


def _scaled(model: Model, cut: float, above: float | None, below: float | None) -> None:
    """Scores by the cut and the median of either class."""
    spread = max(0.25, (cut + 1 if above is None else above) - (cut - 1 if below is None else below))
    model.scale = 8 / spread
    model.shift = float(np.log(PREDICT_AT / (1 - PREDICT_AT)) - model.scale * cut)


def calibrate_over(model: Model, rows: DataFrame) -> Model:
    """``calibrate`` over any number of rows (lang, text, toxic): scored by tasks, and their exact counts taken by score, in buckets of scores."""
    scored = score_column(rows, model, ["lang", "toxic"], "z", raw=True)
    scored = scored.withColumn("lang", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("lang", F.lit(""))))))  # all, and each language
    points = staged(scored.groupBy("lang", "z").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).withColumn("k", F.floor(F.col("z") * 16)), "toxicity-scores")
    before, all_of = Window.partitionBy("lang").orderBy("k"), Window.partitionBy("lang")
    buckets = points.groupBy("lang", "k").agg(F.sum("t").alias("bt"), F.sum("n").alias("bn"), F.min("z").alias("lo"))
    buckets = buckets.select("lang", "k", (F.sum("bt").over(before) - F.col("bt")).alias("below_t"), (F.sum("bn").over(before) - F.col("bn")).alias("below_n"), F.lead("lo").over(before).alias("next_lo"), F.sum("bt").over(all_of).alias("all_t"), F.sum("bn").over(all_of).alias("all_n"))
    order = Window.partitionBy("lang", "k").orderBy("z")
    d = points.join(F.broadcast(buckets), ["lang", "k"])
    d = d.select("lang", "z", "t", "n", "all_t", "all_n", (F.sum("t").over(order) + F.col("below_t")).alias("ct"), (F.sum("n").over(order) + F.col("below_n")).alias("cn"), F.coalesce(F.lead("z").over(order), "next_lo").alias("next_z"))
    clean, all_clean = F.col("cn") - F.col("ct"), F.col("all_n") - F.col("all_t")
    cut = lambda worth, gap, at: F.struct(worth.alias("worth"), gap.cast("double").alias("gap"), (-at).alias("at"))  # noqa: E731  the least cut wins last
    after = cut((F.col("all_t") - F.col("ct")) - 2 * (all_clean - clean), F.coalesce(F.col("next_z") - F.col("z"), F.lit(1)), F.coalesce((F.col("z") + F.col("next_z")) / 2, F.col("z") + 1))
    first = F.when(F.col("cn") == F.col("n"), cut(F.col("all_t") - 2 * all_clean, F.lit(1), F.col("z") - 1))
    ranked = lambda count, total: (F.min(F.when(count > F.floor((total - 1) / 2), F.col("z"))) + F.min(F.when(count > F.floor(total / 2), F.col("z")))) / 2  # noqa: E731  the median
    best = d.groupBy("lang").agg(F.max(after).alias("after"), F.max(first).alias("first"), ranked(F.col("ct"), F.col("all_t")).alias("above"), ranked(clean, all_clean).alias("below"), F.first("all_t").alias("t"), F.first("all_n").alias("n"))
    found = {r["lang"]: r for r in best.select("lang", (-F.greatest("after", "first")["at"]).alias("cut"), "above", "below", "t", "n").collect()}
    _scaled(model, found[""]["cut"], found[""]["above"], found[""]["below"])
    model.cuts = {lang: float(calibrated(model, np.array([r["cut"]]))[0]) for lang, r in sorted(found.items()) if lang and min(r["t"], r["n"] - r["t"]) >= 20}
    return model


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """In the middle of the widest of the best gaps between scores: most right answers, where a wrong alarm counts as two misses."""
    order = np.argsort(z)
    s, t = z[order], y[order]
    caught = t.sum() - np.concatenate([[0], np.cumsum(t)])
    alarms = (1 - t).sum() - np.concatenate([[0], np.cumsum(1 - t)])
    worth = caught - 2 * alarms
    edge = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    gap = np.concatenate([[1], s[1:] - s[:-1], [1]])
    best = np.flatnonzero(worth == worth.max())
    return float(edge[best[gap[best].argmax()]])


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, seed: int = 7) -> Model:
    """A model of all learnable labelled documents."""
    marked = staged(_marked(labels), "toxicity-labels")
    sizes = [r["count"] for r in marked.groupBy("toxic").count().collect()]
    sample = _sample(documents, marked, per_class)
    caps = _caps(_lengths(sample), SAMPLE_LETTERS)
    if max(sizes, default=0) <= per_class and not any(cap is not None for cap in caps.values()):
        return train(_gather(sample, caps), seed=seed)  # these are all
    kept = F.pmod(F.xxhash64(F.lit("toxicity-kept"), "doc_id"), F.lit(5)) == 4
    rows = staged(_labelled(documents, keyed_broadcast(marked, sum(sizes))).withColumn("kept", kept), "toxicity-rows")
    count = {tuple(r)[:2]: r["n"] for r in rows.groupBy("kept", "toxic").agg(F.count("*").alias("n")).collect()}
    fit_n, fit_toxic = count.get((False, 0), 0) + count.get((False, 1), 0), count.get((False, 1), 0)
    network = _learned(_gather(sample.filter(~kept), caps), EPOCHS, seed)
    if network is None:
        return _prior(sum(count.values()), fit_toxic + count.get((True, 1), 0))
    shards = min(SHARDS, -(-fit_n // ROWS_OF_A_SHARD))
    dealt = rows.filter(~F.col("kept")).withColumn("shard", F.pmod(F.xxhash64(F.lit("toxicity-shard"), "doc_id"), F.lit(shards)).cast("int"))
    for number in range(ROUNDS):
        _round(network, dealt, shards, fit_toxic / fit_n, number)
    return calibrate_over(network.model(), rows.filter("kept") if count.get((True, 1), 0) >= LEAST_HELD else rows)


def score_column(documents: DataFrame, model: Model, keep: list[str], name: str = "toxicity_score", raw: bool = False) -> DataFrame:
    """``keep`` columns of ``documents`` and the score as ``name``, before calibration if ``raw``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    spot = unused("text", documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in small(batches):
            out, all_texts = [], texts(batch, spot)
            for part in text_slices(all_texts, LETTERS_AT_ONCE):
                z = scorer.logits([words_of(t) for t in all_texts[part]])
                out += (z if raw else calibrated(shared.value, z)).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.float64())], names=[*keep, name])

    d = documents.select(*keep, F.col("text").cast("string").alias(spot))
    schema = documents.select(*keep).schema.add(name, "double")
    return d.mapInArrow(run, schema)


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    d = score_column(documents.select("doc_id", "text"), fit(documents, labels), ["doc_id"])
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= PREDICT_AT).cast("int").alias("predicted"))


def language_cut(model: Model, lang: Column) -> Column:
    """The score from which a document of this language counts as toxic; PREDICT_AT where the language is null or has no cut of its own."""
    if not model.cuts:
        return F.lit(PREDICT_AT)
    pairs = [F.lit(x) for item in model.cuts.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(lang, F.lit(""))], F.lit(PREDICT_AT))


def reject(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those that reach their language's cut; columns as they came."""
    model = fit(documents, labels)
    name = unused("score", documents)
    scored = score_column(documents, model, documents.columns, name)
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    return scored.filter(F.col(name) < language_cut(model, lang)).select(*documents.columns)
