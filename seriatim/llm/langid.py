"""Language identification: multinomial naive Bayes over hashed character n-grams.

Words are runs of letters, lower-cased; their n-grams carry marks at the word's ends.  The matrix of log
probabilities (buckets x languages) is broadcast; a batch of documents is a sparse matrix of documents by words whose
rows are summed in numpy.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal texts give equal rows; texts are as
long as they are; the first language in alphabetical order wins a tie; repeated rows stay; columns of the input other
than ``doc_id`` and ``text``, whatever their names, are left out; an empty training table makes every document ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriatim.llm.common import LETTERS, WordTable, flat, held_out, keyed_broadcast, learnable, ngram_ids, slices, small, staged, sums, texts

SIZES = (1, 2, 3)
BUCKETS = 1 << 15
#: Training documents a language at most: those with the smallest hashes of their ids.
SAMPLE_PER_LANGUAGE = 400
SMOOTHING = 0.5
#: Words whose scores a task keeps at most before it starts over.
CACHE_WORDS = 300_000


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_probability: np.ndarray  # BUCKETS x languages, float32
    log_prior: np.ndarray


def training_sample(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Up to ``per_language`` learnable documents (text, lang) of each language, by the smallest hash of their ids.

    Ranks are taken within salted parts of a language first, so that a language with most rows is not sorted whole.
    """
    d = documents.filter(learnable() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    d = d.select("doc_id", "lang", "text", F.xxhash64(F.lit("langid"), F.col("doc_id")).alias("h"))
    keys = d.select("doc_id", "lang", "h", F.pmod(F.xxhash64("h"), F.lit(64)).alias("salt"))
    for part in (["lang", "salt"], ["lang"]):
        w = Window.partitionBy(*part).orderBy("h", "doc_id")
        keys = keys.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_language).drop("r")
    chosen = staged(keys.select("doc_id", "lang").distinct(), "langid-sample")
    return d.join(keyed_broadcast(chosen, chosen.count()), ["doc_id", "lang"], "left_semi").select("lang", "text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in small(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            words = LETTERS.findall(text.lower())
            if words:
                ids, _ = ngram_ids(words, SIZES, BUCKETS, whole=False)
                own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(ids, minlength=BUCKETS)
    for lang, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(used), "bucket": used.astype(np.int32), "n": counts[used]})


def fit(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Counts n-grams of the sample by language on the executors, and all learnable documents by language for the prior; the counts (languages x buckets) go to the driver."""
    counted = training_sample(documents, per_language).mapInArrow(_count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    counts[rows["bucket"], rows["lang"].map({x: i for i, x in enumerate(languages)})] = rows["n"]
    smooth = counts + SMOOTHING
    known = documents.filter(learnable() & F.col("text").isNotNull() & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n"))
    share = {r["lang"]: r["n"] for r in known.collect()}  # a row for each language
    prior = np.array([share.get(x, 0) + SMOOTHING for x in languages])
    return Model(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()) if len(prior) else prior)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of the predicted language) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words, table = WordTable(), np.zeros((0, len(m.languages) + 1))
        for batch in small(batches):
            langs, scores = [], []
            all_texts = texts(batch)
            for part in slices(len(all_texts)):
                found, ends = flat([LETTERS.findall(t.lower()) for t in all_texts[part]])
                numbers = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
                if words.fresh:
                    ids, starts = ngram_ids(words.fresh, SIZES, BUCKETS, whole=False)
                    letter = np.array([any(map(str.isalpha, w)) for w in words.fresh], float)
                    table = np.vstack([table, np.column_stack([sums(m.log_probability[ids], starts), letter])])
                    words.fresh = []
                total = sums(table[numbers], ends)
                lettered, total = total[:, -1] > 0, total[:, :-1] + m.log_prior
                if not m.languages:
                    langs += ["und"] * len(total)
                    scores += [0.0] * len(total)
                    continue
                best = total.argmax(axis=1)
                top = 1 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)
                langs += [m.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                scores += np.where(lettered, top, 0.0).tolist()
                if len(words) > CACHE_WORDS:
                    words, table = WordTable(), np.zeros((0, len(m.languages) + 1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    return predict(documents, fit(documents))
