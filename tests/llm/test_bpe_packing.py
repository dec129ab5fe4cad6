from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seriatim.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def pieces_of_noise(n: int) -> list[str]:
    rng = random.Random(1)
    marks = [*"abcABC'sdtmrelv  \t\n\r.,!?0123456789éßñ中文🙂²Ⅷ\x1c\x85\xa0​_-<|>ǅ", "<|endoftext|>", " the", "  ", "\n\n", "aaaa", "'s", "'ll", "क्ष"]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoding_equals_the_library(library):
    texts = [*pieces_of_noise(3000), "", "<|endoftext|>", "a" * 1000, " " * 50, "<|endoftext|> <|endoftext|>", "ab" * 20_000, "\n" * 30_000 + "x", "\t \n" * 10_000]
    v = bpe.vocabulary(bpe.default_path())
    encoder = bpe.Encoder(v)
    ids, bounds = encoder.encode(texts)
    for i, (t, e) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True)):
        own = ids[bounds[i] : bounds[i + 1]]
        assert own.tolist() == e.ids, t
        assert bpe.decode(own, v) == library.decode(e.ids, skip_special_tokens=False)


def quotes_and_blanks(n: int) -> list[str]:
    rng = random.Random(3)
    marks = ["'", "'s", "'re", "'ll", "'d", "'S", "r", "e", "é", "7", " ", "  ", "\n", "\t", "\xa0", "\u3000", ".", "🙂", "中", "x" * 31, "ß" * 17]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_pretokens_of_many_pieces_start_where_the_pattern_matches():
    parts = [*quotes_and_blanks(20_000), *pieces_of_noise(3000), "'", "'r", "'re", "", " ", "  ", ""]
    ends = np.cumsum([0, *map(len, parts)])
    starts = bpe.pretoken_starts("".join(parts), ends)
    for p, a, b in zip(parts, ends, ends[1:], strict=False):
        want = np.zeros(len(p), bool)
        want[[m.start() for m in bpe.PRETOKEN.finditer(p)]] = True
        assert starts[a:b].tolist() == want.tolist(), p
    assert not len(bpe.pretoken_starts("", np.array([0])))


def test_the_coder_of_packing_equals_the_library(library):
    texts = [*quotes_and_blanks(5000), *pieces_of_noise(3000), "", "<|endoftext|>", "a" * 1000, "中" * 5000, "ab" * 20_000, "\n" * 30_000 + "x", *("".join(x) for x in zip("ab" * 40, "cd" * 40, strict=True))]
    texts += [("the" * 20)[:n] for n in range(60)] + [("aaab" * 20)[:n] for n in range(60)]  # lengths about the table's longest
    encoder = packing.coder(bpe.default_path())
    for part in (texts, texts[::-1], []):  # learned, then remembered
        ids, bounds = encoder.encode(part)
        for i, (t, e) in enumerate(zip(part, library.encode_batch(part, add_special_tokens=False), strict=True)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == e.ids, t


def test_new_words_cost_packing_no_pass_for_each_rank(monkeypatch):
    """Steps grow with the length of words, not with the thousands of ranks that many new words meet."""
    rng, calls, ranks = random.Random(4), [], bpe.Vocabulary.ranks
    monkeypatch.setattr(bpe.Vocabulary, "ranks", lambda self, left, right: calls.append(1) or ranks(self, left, right))
    text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 16))) for _ in range(30_000))
    packing.coder(bpe.default_path()).encode([text])
    assert len(calls) <= 2 * sum(range(20)) + 1  # two a round, a round less than a word has bytes


def test_decoding_broken_bytes(library):
    rng, v = random.Random(2), bpe.vocabulary(bpe.default_path())
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(6)]
        assert bpe.decode(np.array(ids), v) == library.decode(ids, skip_special_tokens=False)


def test_round_trip(odd_documents, no_documents, library):
    rows = bpe.round_trip(odd_documents).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd_documents.collect())
    assert len(rows) == odd_documents.count()
    want = Counter()
    for (i, t), n in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    assert Counter(tuple(r) for r in rows) == want
    assert bpe.round_trip(no_documents).count() == 0
    again = bpe.decode_column(bpe.encode_column(odd_documents))
    assert Counter((r["doc_id"], r["text"]) for r in again.collect()) == texts


def used(runs, histogram, capacity):
    bins, got = defaultdict(list), Counter()
    for r in runs:
        for j in range(r.count):
            bins[r.bin + j // r.each].append((r.offset + j % r.each * r.length, r.length))
            got[r.length] += 1
    assert got == Counter(histogram)
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize(("capacity", "n"), [(1, 5), (2, 9), (10, 40), (64, 600), (2048, 4000)])
def test_plan(capacity, n):
    rng = random.Random(capacity)
    for _ in range(5):
        h = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(n))
        bins = used(packing.plan(dict(h), capacity), h, capacity)
        best_fit, gaps = 0, []  # best-fit decreasing, an item at a time
        for length in sorted(h.elements(), reverse=True):
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                best_fit, gap = best_fit + 1, capacity
            else:
                gaps.remove(gap)
            gaps.append(gap - length)
        assert bins <= best_fit * 1.02 + 1
        assert bins >= -(-sum(k * v for k, v in h.items()) // capacity)


def test_plan_of_large_counts():
    h = {n: 10**9 + n for n in range(1, 2049)}
    runs = packing.plan(h)
    got = Counter()
    for r in runs:
        got[r.length] += r.count
    assert got == Counter(h)
    assert len(runs) < 20_000


def test_pack(odd_documents, no_documents, library):
    rows = packing.pack(odd_documents).collect()
    tokens = Counter()
    want = Counter()
    for r in odd_documents.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        tokens["all"] += r["length"]
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-tokens["all"] // 2048) + 2
    assert packing.pack(no_documents).count() == 0


def test_pack_white_space_and_large_ids(spark, library):
    """A run of a million blanks is packed like any text, and ids beyond 53 bits stay whole beside a null."""
    rows = [(2**53 + 1, "\n" * 1_200_000), (None, " " * 300_000), (2**53 + 3, "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    length = Counter()
    for r in got:
        length[r["doc_id"]] += r["length"]
    assert set(length) == {2**53 + 1, None, 2**53 + 3}
    assert length[2**53 + 3] == 2
    assert length[None] == 1 + len(library.encode(" " * 300_000, add_special_tokens=False).ids)
