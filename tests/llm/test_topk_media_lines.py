from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seriatim.llm import line_dedup, media, topk


def brute_topk(rows, k, every):
    def valid(v):
        return v and all(x is not None and math.isfinite(x) for x in v)

    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and valid(v)]
    out = []
    for q, x in {i: v for i, v in whole if i % every == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole if i != q and len(y) == len(x))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 0.002, 3e5])
def test_topk(spark, scale):
    """Ties, repeated vectors, negative scores, odd rows, and few buckets' worth of scores."""
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(0, scale))) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2100, []), (2200, [None] * 6), (2300, [math.nan] * 6), (2400, [math.inf] + [1.0] * 5), (None, [1.0] * 6), (2500, [1.0, 2.0]), (2501, [0.5, 2.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int").repartition(4)
    got = topk.search(df, topk.every(df, 20), block=7)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rows, 10, 20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_topk_large_ids_and_repeated_queries(spark):
    """Ids beyond 53 bits stay whole beside a null, and of query rows with one id the least vector counts."""
    rows = [(2**53 + 1, [1.0, 0.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [-1.0, 0.5]), (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = [tuple(r) for r in topk.search(df, topk.every(df, 20)).orderBy("rank").collect()]
    assert got == [(20, 1, 7, 512 * -1024 + 512 * 512), (20, 2, 2**53 + 1, -1024 * 1024)]


def test_topk_last_buckets(spark):
    """A query's last buckets reach over its span; a score there is above it and must not be counted again."""
    rows = [(1, [352 / 1024]), (2, [252 / 1024]), (3, [10 / 1024])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    # scores from -12,798 to 12,798 fall into buckets of 100: 252 into the one from 202 on, 352 into the next one
    assert topk.thresholds(df, np.array([0]), np.array([[1.0]]), 12797.5, 2).tolist() == [252]


@pytest.mark.parametrize("big", [1e6, 1e12, 3e15, 3e38])
def test_topk_large_components(spark, big):
    """One row of large components leaves the other rows' scores as they are; scores beyond a long are told as the nearest one."""
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(200)] + [(9999, [float(np.float32(big))] * 6), (9998, [float(np.float32(-big))] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in topk.search(df, topk.every(df, 20)).collect())
    want = {}
    for q, _, i, s in brute_topk(rows, len(rows), 20):
        want.setdefault(q, []).append((-max(-topk.MOST, min(topk.MOST, s)), i))
    assert got == sorted((q, r, i, -s) for q, found in want.items() for r, (s, i) in enumerate(sorted(found)[:10], 1))


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, topk.every(df)).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search(one, topk.every(one)).count() == 0


def test_media_report(odd_documents, no_documents):
    rows = media.digest_report(odd_documents).collect()
    want = Counter()
    for r in odd_documents.collect():
        raw = (r["text"] or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        stored = b"P5\n64 %d\n255\n" % (len(data) // 64) + data
        want[r["doc_id"], len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest()] += 1
    assert Counter(tuple(r)[:7] for r in rows) == want
    by = defaultdict(set)
    for r in rows:
        by[r["media_sha256"], r["n_bytes"]].add(r["feature"])
        assert r["position"] == 1
        assert r["caption"] == f"{r['n_bytes']} bytes"
    assert all(len(x) == 1 for x in by.values())
    assert media.digest_report(no_documents).count() == 0


def test_media_sequences(spark):
    page = "<p>One &amp; two</p><figure><img src='digest:aa' alt='no'><figcaption>First <b>one</b></figcaption></figure>mid<img data-digest=bb alt='second'><!-- <img src=x> --><script>var a='<img src=y>'</script> end"
    items = media.sequences(spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, html string"), "k", "html")
    got = {r["k"]: [tuple(i) for i in r["items"]] for r in items.collect()}
    assert got == {1: [(0, "text", "One & two", None, None), (1, "media", None, "aa", "First one"), (2, "text", "mid", None, None), (3, "media", None, "bb", "second"), (4, "text", "end", None, None)], 2: [], 3: []}
    data = bytes(range(64)) * 2
    kept = media.store(spark.createDataFrame([("aa", 128, data), ("aa", 128, data)], "digest string, n_bytes long, payload binary"))
    out = {r["k"]: r["items"] for r in media.interleave(items, media.measure(kept), "k").collect()}
    assert [(i["position"], i["media"] and i["media"]["payload_sha256"]) for i in out[1]] == [(0, None), (1, hashlib.sha256(data).hexdigest()), (2, None), (3, None), (4, None)]
    assert out[2] == []


def slow_feature(data):
    """The feature of a payload, sample by sample."""
    n = len(data)
    mean = sum(data) / n
    spread = math.sqrt(sum(x * x for x in data) * n - sum(data) ** 2)
    columns = bytes(sum(data[i] for i in range(c, n, 64)) // (n // 64) for c in range(64))
    return f"m{math.floor(100 * sum(data) / n)}.d{int(100 * spread / n)}.b{1000 * data.count(0) // n}.{columns.hex()}", mean


def test_features_are_those_of_the_stored_samples(odd_documents, spark):
    rng = random.Random(12)
    texts = ["", "a", "x" * 64, "é" * 200, "".join(chr(rng.randrange(32, 500)) for _ in range(5000))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.digest_report(d).collect():
        raw = texts[r["doc_id"]].encode()
        assert r["feature"] == slow_feature(raw + b"\0" * (-len(raw) % 64 if raw else 64))[0]


def test_items_of_malformed_pages():
    assert [i["digest"] for i in media.parse("<img title=it's src=digest:a>don't<img src='digest:b' alt='x>y'><!-- <img src=digest:c>")] == ["a", None, "b"]
    for page in ("<!--" * 20_000, "<script>" * 20_000, "<a b='c' " * 20_000, "<img x=\"" * 20_000, "<" * 50_000):
        began = time.time()
        media.parse(page)
        assert time.time() - began < 2


def brute_lines(rows, ratio):
    pages, seen = Counter(), Counter()
    for _, host, t in rows:
        pages[host] += 1
        for line in {x for x in (t or "").split("\n") if x.strip(" ")}:
            seen[host, line] += 1
    out = []
    for i, host, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not (x.strip(" ") and seen[host, x] > max(1, ratio * pages[host]))]
        out.append((i, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    rng = random.Random(2)
    rows = []
    for i in range(200):
        host = rng.choice(["a", "a", "b", None])
        lines = [rng.choice(["menu", "footer", "", "  ", f"own {i}", f"x {rng.randrange(30)}"]) for _ in range(rng.randint(0, 6))]
        rows.append((i, host, None if rng.random() < 0.05 else "\n".join(lines)))
    rows += [rows[5], (300, "c", "menu"), (301, "a", "menu\nfooter")]
    df = spark.createDataFrame([(*r, len(r[2] or "")) for r in rows], "doc_id long, source string, text string, n_chars long").repartition(3)
    got = line_dedup.report(df).collect()
    assert Counter(map(tuple, got)) == Counter(brute_lines(rows, line_dedup.MAX_RATIO))
    assert any(r["n_dropped"] for r in got)
    cleaned = line_dedup.clean(df)
    assert cleaned.columns == df.columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in cleaned.collect())


@pytest.mark.parametrize("footer", ["footer", "all rights reserved", "a", "\u00e9 1", "0", "~~~"])
def test_a_footer_goes_whatever_its_text(spark, footer):
    """A line on a tenth of a host's pages is over the ratio, one on a twentieth isn't; it depends on nothing else."""
    rows = [(i, "a", "\n".join([*(f"own {i} {j}" for j in range(8)), *([footer] if i % 10 == 0 else []), *(["rare"] if i % 20 == 1 else [])])) for i in range(400)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(got[i] == (i % 10 == 0) for i in range(400))


def test_lines_of_odd_documents(odd_documents, no_documents):
    assert line_dedup.clean(odd_documents).schema == odd_documents.schema
    assert line_dedup.clean(odd_documents).count() == odd_documents.count()
    assert line_dedup.report(no_documents).count() == 0
