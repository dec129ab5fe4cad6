from __future__ import annotations

import random
import re

import numpy as np
import pytest

from seriatim.llm import ngram_join
from tests.llm.conftest import prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    ids = sorted(i for i in sets if i is not None)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            for s in sets[a]:
                for t in sets[b]:
                    if s and t and 100 * len(s & t) >= 80 * len(s | t):
                        p, q = sorted((root(a), root(b)))
                        comp[q] = p
    return sorted((i, len(shingles(t)), None if i is None else root(i)) for i, t in rows if i is not None)


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def check(spark, rows):
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string, comp string, node string").repartition(3))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect() if r["doc_id"] is not None) == brute([r[:2] for r in rows])


@pytest.mark.parametrize(("held", "spokes"), [(8_000_000, 1000), (400, 3)])
def test_against_brute_force(spark, monkeypatch, held, spokes):
    """Chains of ever more changed copies, hubs, small sets and plain texts; also with tasks that let go of shared signatures early, and hubs dealt over several tasks."""
    monkeypatch.setattr(ngram_join, "HELD", held)
    monkeypatch.setattr(ngram_join, "SPOKES", spokes)
    rng = random.Random(spokes)
    rows, i = [], 0
    for n in (3, 5, 6, 7, 8, 9, 12, 20, 45, 160, 700):
        base = prose(rng, n)
        for _ in range(8):
            rows.append((rng.randrange(10**6) * 1000 + i, base, "c", "n"))
            i += 1
            base = changed(rng, base, max(1, n // 60)) if rng.random() < 0.8 else base + " " + prose(rng, max(1, n // 12))
        hub = prose(rng, n)
        for _ in range(8):
            rows.append((i, changed(rng, hub, max(1, n // 50)), "c", "n"))
            i += 1
    check(spark, rows)


#: A table in which the nearest set by sketch is no link, and the next one is.
TWENTY = "v47750568 v17316293 v11223949 v687655 v18899327 v48458468 v2202227 v2858180 v33669015 v75474655 v61502711 v51380940 v69359455 v10523991 v7130544 v29338191 v26016478 v59410519 v1637128 v63335888"


def test_link_beyond_the_nearest(spark):
    rows = [(1, f"{TWENTY} v31879734 v64579238", "c", "n"), (2, f"{TWENTY} v89258632 v94725340", "c", "n"), (3, f"{TWENTY} v12087988 v38069845 v14895928", "c", "n")]
    assert sorted(r["component_id"] for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string, comp string, node string")).collect()) == [1, 1, 3]


def near_threshold(rng, n):
    """Three texts of ``n`` shared words, of which two are just similar enough and the third isn't to either."""
    same = [f"s{rng.randrange(10**8)}" for _ in range(n)]
    first = n - 4  # shingles that all have
    a = next(k for k in range(1, 99) if 100 * first < 80 * (first + 2 * (k + 1)))
    own = lambda k: " ".join([*same, *(f"o{rng.randrange(10**8)}" for _ in range(k))])
    return [own(a), own(a), own(a + 1)]


@pytest.mark.parametrize("seed", range(3))
def test_near_threshold_triples(spark, seed):
    """Each triple of one size alone in its table, so that no other link helps."""
    rng = random.Random(seed)
    check(spark, [(i + 1, t, "c", "n") for i, t in enumerate(near_threshold(rng, (9, 20, 36)[seed]))])


def test_many_near_threshold_triples(spark):
    rng = random.Random(77)
    texts = [t for n in range(9, 45) for t in near_threshold(rng, n)]
    rng.shuffle(texts)
    check(spark, [(i, t, "c", "n") for i, t in enumerate(texts)])


def test_rows_of_one_id_with_a_map(spark):
    rows = [(1, "a b c", {"k": 2}), (1, "a b c", {"k": 1}), (2, "z", None)]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>"))
    assert sorted((r["doc_id"], (r["m"] or {}).get("k")) for r in got.collect()) == [(1, 1), (2, None)]


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    rng = random.Random(9)
    bases = [prose(rng, 60) for _ in range(3)]
    check(spark, [(k, changed(rng, bases[k % 3], rng.randint(0, 2)), "c", "n") for k in range(90)])


@pytest.mark.parametrize("own", [1, 4, 8, 12, 30])
def test_hot_passages_aren_t_compared_in_pairs(spark, monkeypatch, own):
    """Many texts of one passage and words of their own, few or many, with links among some of them; also parts of the passage alone."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    cooled = []
    plain = ngram_join._Links.cooled

    def told(self, groups):
        out = plain(self, groups)
        cooled.append(out.agg({"size": "max"}).first()[0])
        return out

    monkeypatch.setattr(ngram_join._Links, "cooled", told)
    rng = random.Random(own)
    passage = [f"p{i}" for i in range(40)]
    word = lambda: f"o{rng.randrange(10**7)}"
    tails = [[word() for _ in range(own)] for _ in range(60)]
    rows = [(i, " ".join([*passage, *t])) for i, t in enumerate(tails)]
    rows += [(100 + i, " ".join([*passage, *tails[i][:-1], word()])) for i in range(12)]
    rows += [(200 + i, " ".join(passage[i : i + 36 - i % 3])) for i in range(4)]
    rows += [(300 + i, " ".join([*(word() for _ in range(3)), *passage[i % 5 :], *tails[i]])) for i in range(12)]
    rng.shuffle(rows)
    check(spark, [(i, t, "c", "n") for i, t in rows])
    if own >= 12:
        assert cooled[0] <= 10


def test_blocks_of_signatures():
    """What is packed comes back, and ranges let go of the same groups whether or not they hold all rows to the end."""
    rng = np.random.default_rng(4)
    found = rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64)[rng.integers(0, 3000, 9000)]
    keys, native = rng.integers(-(2**62), 2**62, 40)[rng.integers(0, 40, 9000)], rng.random(9000) < 0.5
    native = (keys ^ found.view(np.int64)) % 2 == 0  # one value for a set and signature
    blocks = list(ngram_join.packed(found, keys, native, 7))
    assert [r for r, _ in blocks] == list(range(7))
    back = [np.concatenate(c) for c in zip(*(ngram_join.unpacked(b) for _, b in blocks), strict=True)]
    order = np.lexsort((keys, found))
    assert len(back[0]) == 9000
    assert sorted(back[1].tolist()) == sorted(keys.tolist())
    assert back[2].sum() == native.sum()
    want = {}
    for f, k, x in zip(found[order].tolist(), keys[order].tolist(), native[order].tolist(), strict=True):
        want.setdefault(f, {})[k] = x
    want = {frozenset(g) for g in want.values() if len(g) > 1 and any(g.values())}
    for most in (10**6, 500):
        got, whole = {}, set()
        for r in range(7):
            shared = ngram_join.SharedSignatures(most, r)
            steps = [b for q, b in ngram_join.packed(found[:4000], keys[:4000], native[:4000], 7) if q == r] + [b for q, b in ngram_join.packed(found[4000:], keys[4000:], native[4000:], 7) if q == r]
            for out in [*(o for b in steps for o in shared.add(*ngram_join.unpacked(b))), *shared.out(True)]:
                for gh, node, _, size in zip(*(out.column(c).to_pylist() for c in ("gh", "node", "native", "size")), strict=True):
                    got.setdefault((r, gh), set()).add(node)
                    if size is not None:
                        whole.add((r, gh, size))
        assert all(len(got[r, gh]) == size for r, gh, size in whole)
        assert want <= {frozenset(g) for g in got.values()}


def test_odd_documents(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    got = ngram_join.classes(odd_documents).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute(rows)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert ngram_join.classes(no_documents).count() == 0
    kept = ngram_join.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for _, _, c in brute(rows)}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 1
    assert ngram_join.keep_one(no_documents).count() == 0


def test_white_space_and_case():
    s = ngram_join.Shingler()
    a, b, c = s(["A b\x0bc\x0cd e f", "a B C\tD\re\nF", "a b c\xa0d e f"])
    assert a.tolist() == b.tolist()
    assert a.tolist() != c.tolist()


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for n in (1, 2, 4, 5, 6, 9, 13, 14, 30, 77, 250, 900):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop, add = rng.integers(0, n // 9 + 1), rng.integers(0, n // 9 + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                s, owner, native = ngram_join.signatures([a, b])
                both = set(s[owner == 0]) & set(s[owner == 1])
                assert both & set(s[native]) or len(np.setxor1d(a, b)) == 0
                x, y = ngram_join.folded([ngram_join.sketch(a), ngram_join.sketch(b)])
                for v in (a, b):
                    assert ngram_join.folded([ngram_join.sketch(v), ngram_join.sketch(v[:1])])[0].tolist() == np.bitwise_xor.reduce(ngram_join.sketch(v).reshape(-1, 8)).view(np.uint64).tolist()
                assert int(np.bitwise_count(x ^ y).sum()) * 180 <= (len(a) + len(b)) * 20
