"""Decontamination, hard negatives and the conversation trie against brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from seriatim.llm import conv_trie, decontam, hard_negatives, queries
from tests.oracle import compare, connection

ITEMS = "item_id long, text string, words string, spans string"


def brute_marks(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k] - {None}
        listed = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["ä", "中文", "x9"]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, said(rng.choice([1, 2, 3, 9, 10, 11, 12, 40]))) for i in range(40)]
    items += [(7, said(30)), (None, said(25)), (100, None), (101, "  ...!"), (102, "a a a a a a a a a a a a a"), (103, items[3][1]), (10, said(14)), (9, said(14))]
    docs = []
    for i in range(120):
        text = said(rng.randint(0, 60))
        if i % 3 == 0:
            _, item = rng.choice([x for x in items if x[1]])
            w = item.split()
            lo = rng.randint(0, max(0, len(w) - 10))
            text = f"{text}, {' -- '.join(w[lo : lo + rng.randint(8, 14)]).upper()}; {said(5)}"
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, "!!"), (503, "a " * 3000), (504, "A a-a " * 4 + "b"), (505, docs[3][1]), (3, docs[3][1]), (None, docs[6][1]), (506, said(30_000))]
    return docs, items


@pytest.mark.parametrize("most", [decontam.WINDOWS, 0])
def test_marks_equal_brute_force(spark, contaminated, most):
    docs, items = contaminated
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = decontam.report(d, spark.createDataFrame(items, "item_id long, text string"), most=most)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_marks(docs, items)


@pytest.mark.parametrize("most", [decontam.WINDOWS, 0])
def test_marks_of_odd_and_empty_tables(spark, odd_documents, no_documents, most):
    none, some = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "the and of", "x", "y")], ITEMS)
    assert decontam.report(no_documents, some, most=most).count() == 0
    assert decontam.report(odd_documents, none, most=most).filter("contaminated or n_items > 0").count() == 0
    d = odd_documents.withColumnsRenamed({"rank": "words", "score": "spans", "copies": "items"})
    p = "marked_"
    marked = decontam.mark(d, some, prefix=p, most=most)
    assert marked.columns == [*d.columns, "marked_words", "marked_spans", "marked_items"]
    assert marked.count() == d.count()
    assert decontam.clean(d, none).count() == d.count()


def test_spans_are_of_words(spark):
    d = spark.createDataFrame([(1, "One two, three four five six seven eight nine ten eleven. Other words", "k")], "doc_id long, text string, kept string")
    item = spark.createDataFrame([(5, "two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    row = decontam.mark(d, item).first()
    assert row["spans"][0].asDict() == {"start": 1, "stop": 11} and row["items"] == ["5"] and row["words"] == 13 and row["kept"] == "k"
    assert decontam.clean(d, item).count() == 0


def test_shared_spans_keep_the_same_fingerprint():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 40, 3000).astype(np.uint64)
    for n in range(1, 11):
        a, b = np.concatenate([rng.integers(0, 40, 50).astype(np.uint64), h[100 : 100 + n]]), h
        assert decontam.kept(a, n)[-1] == decontam.kept(b, n)[100]


def brute_negatives(rows, every=50, positives=5, negatives=3):
    usable = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, label, v in usable:
        if i % every == 0 and (i not in anchors or (v, label) < anchors[i]):
            anchors[i] = (v, label)
    out = []
    for i, (v, label) in anchors.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, k) for j, k, w in usable if j != i and len(w) == len(v)))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(t, u) for t, u, k in scored if k != label and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, j, r, u, -s, -t) for r, (t, u) in enumerate(fits, 1)]
    return sorted(out)


def vectors(rng, n, dim=8, labels=3):
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        rows.append((i, int(rng.integers(labels)), (v / np.sqrt((v * v).sum())).tolist()))
    return rows


@pytest.mark.parametrize("anchor_bytes", [hard_negatives.ANCHOR_BYTES, 300])
def test_negatives_equal_brute_force(spark, anchor_bytes):
    rng = np.random.default_rng(3)
    rows = vectors(rng, 900)
    rows += [(1000 + i, i % 3, rows[50][2]) for i in range(120)]  # a hot vector, with ties
    rows += [(50, 2, rows[7][2]), (3, rows[3][1], rows[3][2]), (None, 1, rows[1][2]), (2000, None, rows[1][2]), (2050, 1, None), (2100, 1, []), (2150, 1, [None] * 8), (2200, 1, [float("nan")] * 8), (2250, 1, [float("inf")] * 8), (2300, 1, [0.0] * 8), (2350, 0, [1.0, 2.0]), (2351, 0, [1.0, 2.0]), (2352, 1, [0.5, 1.0])]
    d = spark.createDataFrame([(*r, "a") for r in rows], "vec_id long, label int, embedding array<double>, rank string").repartition(5)
    own = hard_negatives.usable(d)
    got = hard_negatives.mine(own, own.filter("vec_id % 50 = 0"), anchor_bytes=anchor_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert hard_negatives.report(d.limit(0)).count() == 0


def test_brackets_hold_and_leave_rows_out(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16)) * 200
    x = np.floor(np.repeat(centres, 300, axis=0) + rng.normal(size=(1800, 16)) * 5)
    pivots = hard_negatives.Pivots(x[::7], float(np.sqrt((x * x).sum(axis=1)).max()))
    q = x[:40]
    s = q @ x.T
    shape = (len(q), 1)
    low = np.partition(s, -10, axis=1)[:, -10:-9].astype(np.int64)
    w = hard_negatives.Wanted(np.arange(40), np.zeros(40, np.int64), q, pivots, low, np.full(shape, hard_negatives.MOST), 10, True)
    d, to = pivots.of_rows(x), w.to_pivots
    near, far = np.abs(to[:, None, :] - d[None]).max(axis=2), (to[:, None, :] + d[None]).min(axis=2)
    alive = hard_negatives.Search(w)._alive(np.arange(40), near, far)
    assert alive[s >= low].all() and alive.mean() < 0.5


def brute_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = convs.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    members = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members.setdefault(tuple(paths[c][:d]), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in m if len(paths[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()]
    return sorted(out, key=repr)


def talks(seed=4):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 260), *range(1001, 1080), -5, -120, 3**30]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "bb", "héé", "🙂"]) if t < 3 or c % 3 else f"own {c} {t}"))
    rows += [(2000 + i, t, "user", "copy") for i in range(90) for t in range(8)]
    rows += [(5000, t, "user", f"long {t}") for t in range(700)]
    rows += [(6000, None, None, None), (6000, None, "user", None), (6001, 3, None, "x"), (None, 1, "user", "no id"), (6002, 1, "user", "same"), (6002, 1, "user", "same")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy", [conv_trie.HEAVY, 40, 1])
def test_trie_equals_brute_force(spark, heavy):
    rows = talks()
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, depth string").repartition(3)
    got = conv_trie.trie(d, heavy)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert conv_trie.trie(spark.createDataFrame([], schema)).count() == 0
    turnless = next(c for c in range(300, 400) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(turnless, 0, "user", "gone")]
    assert sorted(map(tuple, conv_trie.trie(spark.createDataFrame(rows, schema)).collect()), key=repr) == brute_trie(rows)


def test_louds_tells_parents_and_children():
    louds = conv_trie.Louds(np.array([2, 0, 1, 0, 0]), 2)
    assert louds.bits.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0]
    assert louds.parents().tolist() == [-1, -1, 0, 0, 2] and louds.children().tolist() == [2, 0, 1, 0, 0]


def test_hashes_of_ends_go_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(conv_trie, "CHUNK", 3)
    rows = [(1, 0, c) for c in range(40)] + [(1, 2, 7), (5, 1, 10), (5, 1, 9)]
    got = {(r["node"], r["depth"]): r["ends"] for r in conv_trie.ends_hashes(spark.createDataFrame(rows, "node long, depth long, conv_id long")).collect()}
    for key in {r[:2] for r in rows}:
        assert got[key] == hashlib.sha256(",".join(str(c) for c in sorted(c for *k, c in rows if tuple(k) == key)).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_conversation_trie", "op13_decontamination"])
def test_queries_equal_sql(spark, sf_dir, name):
    compare(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], connection(sf_dir))
