from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from seriatim.llm import line_dedup, ngram_join, packing, secrets, toxicity
from tests.llm.test_classifiers_secrets_html import brute_spans
from tests.llm.test_ngram_join import brute
from tests.llm.test_topk_media_lines import brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, as written."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns_stay(stages):
    first = stages["toxicity"][0].columns
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == first, name


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(before, labels)
    scored = toxicity.score_column(before, model, ["doc_id", "lang"]).collect()
    cut = lambda lang: model.cuts.get(lang, toxicity.PREDICT_AT)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in scored if r["toxicity_score"] < cut(r["lang"]))


def test_lines(stages):
    before, after = stages["line_dedup"]
    want = brute_lines([(r["doc_id"], r["source"], r["text"]) for r in before.collect()], line_dedup.MAX_RATIO)
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == sorted((i, t) for i, _, _, t in want)


def test_near_copies(stages):
    before, after = stages["ngram_jaccard_join"]
    want = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in before.collect()])}
    assert {r["doc_id"] for r in after.collect()} == want
    assert after.exceptAll(before).isEmpty()
    assert ngram_join.keep_one(after).count() == after.count()


def test_secrets(stages):
    before, after = stages["secret_scans"]
    new = {r["doc_id"]: r["text"] for r in after.collect()}
    assert len(new) == before.count()
    for r in before.collect():
        spans = brute_spans(r["text"])
        if spans:
            assert secrets.REDACTED in new[r["doc_id"]]
        assert not [s for s in brute_spans(new[r["doc_id"]]) if s[0] != "assign"]


def test_packing(stages, spark):
    before, after = stages["best_fit_packing"]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter(F.col("n") > packing.CAPACITY).isEmpty()
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == after.columns
    assert run.count() == after.count()


def test_secret_formats_come_from_all_documents(spark):
    """Credentials under a name, and bare ones, stand in the last 1,000 of 21,000 documents by hash only."""
    rng = random.Random(24)
    key = lambda: "".join(rng.choice("ABCDEFGHJKMN") for _ in range(4)) + "".join(rng.choice("0123456789ABCDEFGHJK") for _ in range(20)) + "".join(rng.choice("qxz") for _ in range(3))
    word = lambda: "".join(rng.choice(["the", "ing", "and", "tion", "er", "stone", "light", "re"]) for _ in range(rng.randint(3, 6)))
    ids = [r[0] for r in spark.range(21_000).orderBy(F.xxhash64(F.lit("secrets"), "id"), "id").collect()]
    texts, bare = {i: f"{word()} {word()} {word()}" for i in ids}, {}
    for n, i in enumerate(ids[-1000:]):
        if n % 3 == 0:
            texts[i] += f"\napi_key: {key()}"
        elif n % 10 == 1:
            bare[i] = key()
            texts[i] += f"\nsee {bare[i]} there"
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    after = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact_secrets(spark, d, SF).collect()}
    assert sum(bare[i] not in after[i] for i in bare) >= 0.95 * len(bare) > 50
    assert all(after[i] == t for i, t in texts.items() if i not in bare and "api_key" not in t)
