from __future__ import annotations

import copy
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriatim.llm import html_text, langid, secrets, toxicity
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_languages(spark, odd_documents, no_documents):
    d = table(spark, "documents")
    rows = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == d.count()
    own = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in own) / len(own) > 0.97
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    odd = langid.predict(odd_documents, langid.fit(d)).collect()
    assert len(odd) == odd_documents.count()
    text = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    for r in odd:
        if not re.search(r"[^\W\d_]", text[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.identify(no_documents).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_documents, langid.fit(no_documents)).collect()} == {"und"}


def test_languages_against_plain_loops(spark):
    """Log probabilities, prior and posterior of hashed n-grams, counted one by one."""
    rng = random.Random(15)
    rows = [(i, "de" if i % 4 else "en", " ".join(rng.choice(["und", "der", "the", "of", "Straße", "a"]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(d)

    def grams(text):
        return [i for w in re.findall(r"[^\W\d_]+", text.lower()) for i in langid.ngram_ids([w], langid.SIZES, langid.BUCKETS, whole=False)[0].tolist()]

    known = [r for r in rows if not held(r[0])]
    counts = {x: Counter(g for _, y, t in known if y == x for g in grams(t)) for x in ("de", "en")}
    prior = {x: sum(y == x for _, y, _ in known) + 0.5 for x in counts}
    assert model.languages == ["de", "en"]
    for r in langid.predict(d, model).collect():
        text = rows[r["doc_id"]][2]
        logs = {x: math.log(prior[x] / sum(prior.values())) + sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * langid.BUCKETS)) for g in grams(text)) for x, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        if not text:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == best
            assert abs(r["score"] - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-4


def test_languages_learn_without_held_out_rows(spark):
    d = table(spark, "documents")
    changed = d.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    assert {r["lang_pred"] for r in langid.identify(changed).select("lang_pred").distinct().collect()} == {"en", "fr", "de", "es"}


def test_toxicity(spark, odd_documents, no_documents):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))  # the smaller ones have too few labels
    model = toxicity.fit(d, labels)
    rows = toxicity.score(d, labels).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    own = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    toxic = [r["predicted"] for r in own if r["toxic"]]
    assert sum(toxic) / len(toxic) > 0.7
    assert sum(r["predicted"] for r in own if not r["toxic"]) / (len(own) - len(toxic)) < 0.02
    odd = toxicity.score_column(odd_documents, model, ["doc_id"]).collect()
    assert len(odd) == odd_documents.count()
    by = {r["doc_id"]: r["toxicity_score"] for r in odd}
    assert by[6] == by[7]
    assert by[0] == by[1] == by[2]
    assert toxicity.score(no_documents, labels).count() == 0
    kept = toxicity.reject(odd_documents, labels)
    assert kept.schema == odd_documents.schema
    assert toxicity.score(odd_documents, labels.limit(0)).count() == odd_documents.count()


def alone(model, text):
    """A document's score by plain loops over its own windows."""
    words = toxicity.words_of(text)
    blank = np.zeros(model.table.shape[1])
    rows = []
    for w in words:
        ids, _ = toxicity.ngram_ids([w], toxicity.GRAMS, toxicity.BUCKETS, whole=True)
        rows.append(sum(model.table[i].astype(float) for i in ids) / len(ids) ** 0.5)
    best, column = [], 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            at = [sum((rows[i + o] if i + o < len(rows) else blank)[column + o * toxicity.FILTERS + f] for o in range(width)) for i in range(max(1, len(rows)))]
            best.append(max(at))
        column += width * toxicity.FILTERS
    z = sum(max(0.0, b + c) * w for b, c, w in zip(best, model.bias, model.weight, strict=True)) + model.out_bias
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.scale * z + model.shift))))


def test_toxicity_of_a_document_is_its_own(spark):
    """Equal to plain loops over one document, whatever stands beside it, in any order and any number of parts."""
    rng = random.Random(8)
    bad = lambda: prose(rng, rng.randint(0, 5)) + " vile nasty " + prose(rng, rng.randint(0, 5))
    sample = [(None, toxicity.words_of(bad() if i % 2 else prose(rng, rng.randint(0, 12))), i % 2) for i in range(120)]
    model = toxicity.train(sample)
    texts = ["", "one", "one two", None, "vile", "nasty vile", *(bad() for _ in range(40)), *(prose(rng, n) for n in range(30))]
    rows = [(i, t) for i, t in enumerate(texts + texts[::-1])]
    want = {i: alone(model, t or "") for i, t in rows}
    seen = []
    for parts, order in ((1, rows), (7, rows), (1, rows[::-1]), (3, rng.sample(rows, len(rows)))):
        d = spark.createDataFrame(spark.sparkContext.parallelize(order, parts), "doc_id long, text string")
        got = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score_column(d, model, ["doc_id"]).collect()}
        assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
        seen.append(got)
    assert all(s == seen[0] for s in seen)


def test_long_labelled_texts_leave_no_other_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_LETTERS", 20_000)
    rng = random.Random(12)
    bad = lambda n: " ".join(rng.choice(["vile", "nasty", "awful"]) for _ in range(n))
    rows = [(i, f"{prose(rng, 20)} {bad(3)}" if i % 2 else prose(rng, 23), i % 2) for i in range(200)]
    rows += [(1000 + i, f"{prose(rng, 20_000)} {bad(20_000)}", 1) for i in range(30)] + [(2000 + i, prose(rng, 30_000), 0) for i in range(30)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sample = toxicity._gather(toxicity.training_sample(d, labels))
    assert len(sample) == sum(not held(i) for i, _, _ in rows)
    by_class = [[w for _, w, y in sample if y == c] for c in (0, 1)]
    for own in by_class:
        assert sum(len(w) for words in own for w in words) <= 20_000
    assert sum("vile" in w for w in by_class[1]) > 0.7 * len(by_class[1])
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity.score(d, labels).collect()}
    assert sum(predicted[i] == y for i, _, y in rows) > 0.9 * len(rows)


def test_training_text_that_fits_is_whole(spark):
    d = spark.createDataFrame([(0, "one two"), (1, "three " * 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    sample = toxicity.training_sample(d, labels)
    assert {y: len(w) for _, w, y in toxicity._gather(sample)} == {r["toxic"]: len(r["text"].split()) for r in sample.collect()}


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Signs of toxicity that few of many rows have are known, though the driver trains on few rows only; whatever the partitions."""
    rng = random.Random(21)
    signs = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(80)]
    rows = [(i, f"{prose(rng, 6)} {signs[i // 2 % 80]} {prose(rng, 6)}" if i % 2 else prose(rng, 13), i % 2) for i in range(4800)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, per_class=30)
    predicted = {r["doc_id"]: r["toxicity_score"] >= toxicity.PREDICT_AT for r in toxicity.score_column(d, model, ["doc_id"]).collect()}
    own = [(i, y) for i, _, y in rows if held(i)]
    assert sum(predicted[i] for i, y in own if y) > 0.9 * sum(y for _, y in own)
    assert sum(predicted[i] for i, y in own if not y) < 0.05 * sum(1 - y for _, y in own)
    again = toxicity.fit(d.repartition(7), labels.repartition(3), per_class=30)
    assert np.array_equal(again.table, model.table)
    assert (again.scale, again.shift, again.cuts) == (model.scale, model.shift, model.cuts)


@pytest.mark.parametrize("ties", [False, True])
def test_cuts_from_counts_are_those_of_the_rows(spark, ties):
    rng = random.Random(22)
    words = ["vile", "nasty"] if ties else [f"vile{i}" for i in range(50)]
    text = lambda y: f"{'' if ties else prose(rng, 5)} {rng.choice(words) if y != (rng.random() < 0.1) else 'plain'}"
    rows = [(rng.choice(["en", "fr", "", None]), text(i % 2), i % 2) for i in range(500)] + [("de", "vile", 1)] * 5
    model = toxicity.train([(lang, toxicity.words_of(t), y) for lang, t, y in rows])
    got = toxicity.calibrate_over(copy.deepcopy(model), spark.createDataFrame(rows, "lang string, text string, toxic int").repartition(5))
    want = toxicity.calibrate(copy.deepcopy(model), [(lang, toxicity.words_of(t), y) for lang, t, y in rows])
    scores = toxicity.Scorer(model).logits([toxicity.words_of(t) for _, t, _ in rows])
    assert set(got.cuts) == set(want.cuts) >= {"en", "fr"}
    if ties:  # a cut through equal scores, as counts by row allow, is none
        cut = (math.log(toxicity.PREDICT_AT / (1 - toxicity.PREDICT_AT)) - got.shift) / got.scale
        assert min(abs(z - cut) for z in scores) > 1e-6
    else:
        assert abs(got.scale - want.scale) < 1e-9 and abs(got.shift - want.shift) < 1e-9
        assert all(abs(got.cuts[x] - want.cuts[x]) < 1e-9 for x in want.cuts)


def brute_spans(text):
    out = []
    for kind, pattern, group, least in (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return [(k, a, b) for a, k, b in sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))]


def test_rules():
    rng = random.Random(5)
    parts = ["password", "PassWD ", "secret", "api_key", "apikey", "token", "=", ": ", '"', "'", " ", "AKIA", "0123456789abcdef" * 2, "ABCDEFGHIJKLMNOP", "deadbeef", "x", "é", "ſecret", "-._/+", "\n", "short"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secrets.rule_spans(t) == brute_spans(t), t


def test_scan_and_redact(spark, odd_documents, no_documents):
    d = table(spark, "documents")
    model = secrets.fit(d)
    text = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}
    for r in secrets.scan(d, model).collect():
        base = brute_spans(text[r["doc_id"]])
        n = Counter(k for k, _, _ in base)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (n["assign"], n["access"], n["hex"], hashlib.sha256(line.encode()).hexdigest())
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))
    assert secrets.scan(odd_documents, model).count() == odd_documents.count()
    assert secrets.scan(no_documents).count() == 0
    out = secrets.redact(odd_documents, model)
    assert out.schema == odd_documents.schema
    left = {r["doc_id"]: r for r in out.collect()}
    assert left[15]["text"] == secrets.REDACTED
    assert left[15]["n_chars"] == len(secrets.REDACTED)
    assert left[0]["text"] is None
    assert left[9]["text"] == {r["doc_id"]: r["text"] for r in odd_documents.collect()}[9]


def test_learned_formats():
    rng = random.Random(8)
    keys = ["key-" + "".join(rng.choice("0123456789") for _ in range(12)) + "-" + "".join(rng.choice("xyz") for _ in range(8)) for _ in range(120)]
    words = ["".join(rng.choice(["the", "ing", "and", "tion", "er", "stone"]) for _ in range(8)) for _ in range(200)]
    model = secrets.train({"assign": keys[:60]}, words[:100])
    assert sum(model.score(k) > model.cut for k in keys[60:]) >= 55
    assert not any(model.score(w) > model.cut for w in words[100:])
    spans = secrets.all_spans(f"see {keys[100]} and {words[150]}", model)
    assert spans == [("learned", 4, 4 + len(keys[100]))]


@pytest.mark.parametrize("bare", [1, 20, 60])
def test_learned_formats_with_credentials_among_the_other_runs(bare):
    rng = random.Random(9)
    keys = ["key-" + "".join(rng.choice("0123456789") for _ in range(12)) + "-" + "".join(rng.choice("xyz") for _ in range(8)) for _ in range(120)]
    words = ["".join(rng.choice(["the", "ing", "and", "tion", "er", "stone"]) for _ in range(8)) for _ in range(200)]
    numbers = ["".join(rng.choice("0123456789") for _ in range(24)) for _ in range(40)]
    model = secrets.train({"assign": keys[:60]}, words[:100] + numbers[:20] + keys[60 : 60 + bare])
    assert all(model.found(k) for k in keys[60 : 60 + bare])
    assert not any(model.found(w) for w in words + numbers)


def test_learned_formats_of_the_fitted_table(spark):
    rng = random.Random(10)
    keys = ["".join(rng.choice("0123456789ABCDEFGHJK") for _ in range(32)) for _ in range(60)]
    texts = [f"token={k} here" for k in keys[:40]] + [f"see {k} and {''.join(rng.choice(['the', 'ing', 'tion']) for _ in range(9))}" for k in keys[40:]]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["spans"] for r in rows if r["doc_id"] >= 40} == {i: "learned:4:36" for i in range(40, 60)}


def slow_likelihood(a, run):
    """One run, one character at a time."""
    total, state = 0.0, 0
    for c in run:
        k = secrets._LETTERS.index(c)
        total += a.chars[state][k]
        state = a.moves[state][secrets._BRANCH[k]]
    return total + a.end[state]


def test_automata_against_plain_loops():
    rng = random.Random(13)
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16)) for _ in range(80)]
    a = secrets.learn([k.encode() for k in keys])
    assert len(a.end) == 21  # the length of the format, and its first four characters
    for chars, end in zip(np.exp(a.chars), np.exp(a.end), strict=True):
        assert abs(chars.sum() + end - 1) < 1e-9
    assert np.exp(a.end[20]) > 0.75
    assert np.exp(a.end[:20]).max() < 1e-3
    runs = [b"AKIA" + bytes(rng.choice(b"ABCZ9-_=x") for _ in range(n)) for n in (*range(40), 600, 5000)] + [k.encode() for k in keys]
    codes, ends = secrets.coded(runs)
    assert np.allclose(a.likelihoods(codes, ends), [slow_likelihood(a, r) for r in runs])
    b = secrets.Background.of(codes, ends, np.ones(len(runs)))

    def kind(c):
        return "0" if chr(c).isdigit() else "A" if chr(c).isupper() else "a" if chr(c).islower() else chr(c)

    steps = [list(zip(b"^" + r, r + b"^", strict=True)) for r in runs]
    pairs, firsts = Counter(p for s in steps for p in s), Counter(x for s in steps for x, _ in s)
    kinds, kind_firsts = Counter((kind(x), kind(y)) for s in steps for x, y in s), Counter(kind(x) for s in steps for x, _ in s)
    seen = Counter(y for s in steps for _, y in s)
    sizes = Counter(map(kind, secrets._LETTERS + b"^"))
    whole = {k: sum(n for c, n in seen.items() if kind(c) == k) + sizes[k] for k in sizes}
    for own, got in zip(steps, b.likelihoods(codes, ends), strict=True):
        one = sum(math.log((pairs[p] + 1) / (firsts[p[0]] + secrets.K + 1)) for p in own)
        two = sum(math.log((kinds[kind(x), kind(y)] + 1) / (kind_firsts[kind(x)] + len(sizes)) * (seen[y] + 1) / whole[kind(y)]) for x, y in own)
        assert abs(got - np.logaddexp(one, two) + math.log(2)) < 1e-6 * max(1, len(own))
    mixed = secrets.learn([bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(8, 30))) for _ in range(200)])
    assert len(mixed.end) < 10  # compatible states are merged


def test_short_formats_and_runs_beside_rules():
    rng = random.Random(14)
    pin = lambda: f"{rng.randrange(100):02d}-{rng.randrange(100):02d}-{rng.choice('QXZ')}{rng.choice('QXZ')}{rng.randrange(10)}{rng.choice('QXZ')}"
    pins = [pin() for _ in range(90)]
    words = ["".join(rng.choice(["the", "ing", "and", "tion", "er", "stone"]) for _ in range(3)) for _ in range(400)]
    model = secrets.train({"assign": pins[:70]}, words[:300])
    assert sum(model.found(p) for p in pins[70:]) >= 18
    assert not any(model.found(w) for w in words[300:])
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(80)]
    model = secrets.train({"hex": keys[:60]}, words[:300])
    text = f"see {keys[70]}9Q here, token={keys[71]}"
    base = brute_spans(text)
    spans = secrets.all_spans(text, model)
    assert set(base) <= set(spans)
    assert ("learned", 4, 38) in spans  # reaches beyond the rule's span
    assert not [s for s in spans if s[0] == "learned" and s[1] > 38]  # a rule's span covers it


def test_words_are_no_format(spark):
    words = sorted({w for r in table(spark, "documents").limit(300).collect() for w in re.findall(r"[A-Za-z]{6,}", r["text"] or "")})
    random.Random(11).shuffle(words)
    model = secrets.train({"assign": words[:100]}, words[100:1000])
    assert not any(model.found(w) for w in words[100:])


class Visible(HTMLParser):
    """Words of a page, by a plain parser."""

    def __init__(self, page):
        super().__init__()
        self.words, self.off = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "head") and self.off > 0

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


def test_pages_keep_all_visible_words(spark):
    pages = table(spark, "pages")
    out = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        marks = re.compile(r"(?m)^[ ]*(?:- |\d+\. )")
        assert "".join(marks.sub("", out[r["page_id"]]).split()) == "".join(Visible(r["html"]).words)


CASES = [
    ("<p>a<p>b <b>c</b><br>d", "a\n\nb c\nd"),
    ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>", "- one\n- two\n  3. x\n  4. y"),
    ("<table><tr><th>A<th>Beta<tr><td>long cell<td>2</table>", "A          Beta\nlong cell  2"),
    ("<table><caption>T</caption><tr><td colspan=2>ab<td>c<tr><td>x<td>y<td>z</table>", "T\nab     c\nx   y  z"),
    ("x<pre>\n a\n  b\n</pre>y", "x\n\n a\n  b\n\ny"),
    ("a<div hidden>no</div><span style='display:none'>no</span><input type=hidden value=v>b", "ab"),
    ("<head><title>t</title></head><script>if (a<b) x()</script>&lt;ok&gt;<!-- no -->", "<ok>"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("</p></div>stray<p>", "stray"),
    ("a < b and c<d", "a < b and c<d"),
    ("<div><div>x</div>y</div>z", "x\ny\nz"),
    ("<blockquote><p>q</blockquote>r", "  q\n\nr"),
    ("", ""),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_layout(page, text):
    assert html_text.text_of(page) == text


WHOLE_CASES = [
    ("a<div hidden>" + "<div>" * 200 + "no" + "</div>" * 200 + "no</div>b", "ab"),
    ("<div>" * 200 + "<template>no</template><p style='display:none'>no</p>in" + "</div>" * 200 + "out", "in\nout"),
    ("<div>" * 200 + "<ul><li>x<li>y</ul>" + "</div>" * 200, "- x\n- y"),
    ("<div>" * 30_000 + "in" + "</div>" * 30_000 + "out", "in\nout"),
    ("a <svg><title>t</title><desc>d</desc><circle r=1 /><text>drawn</text></svg> <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b", "a drawn x=1 b"),
    ("<table><tr><td rowspan=2>ab<td>c<td>d<tr><td>x<td>y<tr><td>z</table>", "ab  c  d\n    x  y\nz"),
    ("<table><tr><td>k<td rowspan=0 colspan=2>ab<tr><td>l<td>m<tbody><tr><td>n<td>o<td>p</table>", "k  ab\nl         m\nn  o   p"),
]


LONG = " ".join(["word"] * 12)
WHOLE_CASES += [
    ("a<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no<p>no</div>b", "a\nyes\nb"),
    ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>x<td>no</table>", "  x"),
    (f"<table><tr><td>a<td>{LONG}<td>z<tr><td>ab<td>c<td>d<br>e</table>", f"a   {LONG}\n       z\nab  c  d\n       e"),
    (f"<table><tr><td>{LONG}<td>{LONG}<td>z<tr><td>a<td>b<td>c</table>", f"{LONG}\n   {LONG}\n      z\na  b  c"),
    ("<table><tr><td colspan=300>a<td>b</table>", "a" + "  " * 299 + "  b"),
    ("a<p title='x", "a<p title='x"),
    ("<p><a title=it's>hello</a> don't <b>x</b> tail</p>", "hello don't x tail"),
    ("<p class = 'a>b' id=\"c>d\" e='>f</p>", "f"),
    ("<p a=\"x 'y' >z\" b>w</p><i it's>v</i>", "w\n\nv"),
    ("<ol><li>a<li value=7>b<li>c<li value=x>d</ol><ul><li value=3>e</ul>", "1. a\n7. b\n8. c\n9. d\n\n- e"),
]


@pytest.mark.parametrize(("page", "text"), WHOLE_CASES)
def test_layout_of_deep_drawn_and_spanning_elements(page, text):
    assert html_text.text_of(page) == text


class Page:
    """A random page and what a reader sees of it, told block by block without any parser.

    Blocks are (lines, spaced): a blank line goes before and after spaced ones.
    """

    def __init__(self, seed):
        self.rng = random.Random(seed)
        self.blocks = self.several(0)

    def pick(self, *options):
        return self.rng.choice(options)

    def words(self):
        """Markup and text of inline content."""
        markup, told = [], []
        for _ in range(self.rng.randint(1, 4)):
            w = self.pick("stone", "river's", "a b", "five &lt; six", "&eacute;t&eacute;", "x=1")
            plain = w.replace("&lt;", "<").replace("&eacute;", "\u00e9")
            k = self.rng.randrange(6)
            markup.append(w if k < 2 else f"<b title=it's>{w}</b>" if k == 2 else f"<a href='x>y' hidd=en>{w}</a>" if k == 3 else f"{w}<span hidden>never</span>" if k == 4 else f"<i>{w}</i><!-- <p>never -->")
            told.append(plain)
        gap = self.pick(" ", "  ", "\n\t")
        return gap.join(markup), " ".join(told)

    def end(self, tag):
        """End tags that HTML lets one leave out are left out now and then."""
        return "" if self.rng.random() < 0.5 else f"</{tag}>"

    def several(self, depth):
        markup, lines, gap = [], [], False
        for _ in range(self.rng.randint(1, 4)):
            m, own, spaced = self.block(depth)
            markup.append(m)
            if lines and (spaced or gap):
                lines.append("")
            lines += own
            gap = spaced
        return "".join(markup), lines

    def block(self, depth):
        kind = self.pick("p", "h2", "section", "ul", "ol", "table", "pre", "quote", "lost") if depth < 3 else self.pick("p", "pre")
        if kind in ("p", "h2"):
            m, t = self.words()
            return f"<{kind}>{m}</{kind}>" if kind == "h2" else f"<p class=k>{m}</p>", [t], True
        if kind == "section":
            m, lines = self.several(depth + 1)
            return f"<section>{m}</section>", lines, False
        if kind == "quote":
            m, lines = self.several(depth + 1)
            return f"<blockquote>{m}</blockquote>", ["  " + x if x else "" for x in lines], True
        if kind == "pre":
            body = self.pick("a\n  b", "x", "  two\n\nthree")
            return f"<pre>\n{body}</pre>", body.split("\n"), True
        if kind == "lost":
            m, t = self.words()
            hidden = self.pick("<div hidden><p>never</div>", "<script>if (a<b) '<p>'</script>", "<style>p{}</style>", "<div style='display: none'><ul><li>never</ul></div>")
            return f"{hidden}<div>{m}</div>", [t], False
        if kind == "table":
            rows = [[self.pick("a", "bb", "long cell", "&amp;", "") for _ in range(self.rng.randint(1, 3))] for _ in range(self.rng.randint(1, 3))]
            markup = "".join("<tr>" + "".join(f"<td>{c}{self.end('td')}" for c in r) + self.end("tr") for r in rows)
            told = [[c.replace("&amp;", "&") for c in r] for r in rows]
            width = [max((len(r[i]) for r in told if i < len(r)), default=0) for i in range(3)]
            lines = ["  ".join(c.ljust(width[i]) for i, c in enumerate(r)).rstrip() for r in told]
            seen = [x for x, r in zip(lines, told, strict=True) if any(r)]
            return (f"<table>{markup}</table>", lines, True) if len(seen) == len(lines) else self.block(depth)
        items = [self.words() for _ in range(self.rng.randint(1, 4))]
        number, markup, lines = 0, "", []
        for m, t in items:
            jump = self.rng.randint(0, 30) if self.rng.random() < 0.3 else None
            number = number + 1 if jump is None else jump
            markup += f"<li{'' if jump is None else f' value={jump}'}>{m}{self.end('li')}"
            lines.append(f"{number}. {t}" if kind == "ol" else f"- {t}")
        return f"<{kind}>{markup}</{kind}>", lines, True


@pytest.mark.parametrize("seed", range(300))
def test_layout_of_random_pages(seed):
    markup, lines = Page(seed).blocks
    assert html_text.text_of(f"<!doctype html><html><head><title>never</title><meta x></head><body>{markup}") == "\n".join(lines).strip("\n")


def test_unclosed_quotes_take_no_long(spark):
    for page in ("<p a=" * 20_000, "<p a=\"" * 20_000, "<a b='c' " * 20_000 + ">", "<p " + "= " * 50_000, "x<p title='" + "y" * 200_000):
        began = time.time()
        html_text.text_of(page)
        assert time.time() - began < 2


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "in" + "</div>" * 5000
    wide = "<table>" + "".join(f"<tr><td>{'w' * 50_000 if i == 3 else i}<td>v" for i in range(200)) + "</table>"
    df = spark.createDataFrame([(1, None, "t"), (2, deep, "t"), (3, wide, "t"), (4, "<p>" + prose(random.Random(1), 20_000), "t"), (4, "<td>x", "t"), (None, "<b", "t")], "page_id long, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 6
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] is None
    assert by[2] == "in"
    assert len(by[3]) < 80_000
    assert html_text.extract(df.limit(0)).count() == 0


def planted(spark):
    """The given documents, some with a credential under a name and some with a bare one of the same format."""
    rng = random.Random(21)
    key = lambda: "".join(rng.choice("ABCDEFGHJKMN") for _ in range(4)) + "".join(rng.choice("0123456789ABCDEFGHJK") for _ in range(20)) + "".join(rng.choice("qxz") for _ in range(3))
    rows = [(r["doc_id"], r["text"] or "") for r in table(spark, "documents").orderBy("doc_id").collect()]
    bare = {}
    for n, (i, t) in enumerate(rows):
        if n % 3 == 0:
            rows[n] = (i, f"{t}\napi_key: {key()}")
        elif n % 3 == 1:
            k = key()
            rows[n], bare[i] = (i, f"{t}\nsee {k} there"), (len(t) + 5, len(t) + 5 + len(k))
    return rows, bare


def test_bare_credentials_among_the_given_documents(spark):
    """Learned spans are the planted ones and no others, base spans are those of brute force, and every span has its score."""
    rows, bare = planted(spark)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = secrets.fit(d)
    text = dict(rows)
    learned, false = 0, 0
    for r in secrets.scan(d, model).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert [s for s in spans if s[0] != "learned"] == brute_spans(text[r["doc_id"]])
        assert len(spans) == len(r["scores"])
        for (kind, a, b), score in zip(spans, r["scores"], strict=True):
            value = text[r["doc_id"]][a:b]
            value = re.split(r"[:=] *[\"']?", value, maxsplit=1)[-1] if kind == "assign" else value
            assert math.isclose(score, model.score(value), rel_tol=1e-9)
            if kind == "learned":
                learned += bare.get(r["doc_id"]) == (a, b)
                false += bare.get(r["doc_id"]) != (a, b)
                assert score > model.cut
    assert false == 0
    assert learned >= 0.95 * len(bare) > 30


def test_formats_background_and_cut_of_more_runs_than_the_driver_takes(spark, monkeypatch):
    """States come from a few credentials; likelihoods, background and cut are those of all, whole ones, counted one by one."""
    monkeypatch.setattr(secrets, "SAMPLE_RUNS", 30)
    monkeypatch.setattr(secrets, "SAMPLE_OTHERS", 50)
    rng = random.Random(25)
    keys = sorted({"".join(rng.choice("ABCDEF") for _ in range(4)) + "".join(rng.choice("0123GHK") for _ in range(rng.choice([8, 8, 8, 150, 700]))) for _ in range(120)})
    words = sorted({"".join(rng.choice(["the", "ing", "and", "tion", "er", "stone"]) for _ in range(rng.randint(3, 8))) for _ in range(600)} | {"8G" * 450, "wide" * 200})
    rows = [(i, f"token={k}") for i, k in enumerate(keys)] + [(None if i % 7 == 0 else 1000 + i, f"{w} {rng.choice(words)}") for i, w in enumerate(words)]
    model = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    hashed = spark.createDataFrame([(k.encode(),) for k in keys], "run binary").select("run", (F.pmod(F.xxhash64(F.lit("secrets-kept"), F.lit("assign"), "run"), F.lit(5)) == 0).alias("kept"))
    kept = {bytes(r["run"]) for r in hashed.collect() if r["kept"]}
    learned = [k.encode() for k in keys if k.encode() not in kept]
    assert min(len(kept), len(learned)) > 10
    first = secrets.learn([k[: secrets.RUN_LETTERS + 1] for k in sorted(learned, key=lambda k: (zlib.crc32(k), k))[:30]])
    chars, last = np.zeros((len(first.end), secrets.K)), np.zeros(len(first.end))
    for k in learned:
        state = 0
        for c in map(secrets._LETTERS.index, k):
            chars[state, c] += 1
            state = first.moves[state][secrets._BRANCH[c]]
        last[state] += 1
    automaton = secrets.Automaton.counted(chars, last, first.moves)
    codes, ends = secrets.coded([w.encode() for w in words])
    want = secrets.Model({"assign": automaton}, secrets.Background.of(codes, ends, np.ones(len(words))), 0.0)
    secrets._separate(want, codes, ends)
    assert list(model.automata) == ["assign"]
    got = model.automata["assign"]
    assert np.allclose(got.chars, automaton.chars) and np.allclose(got.end, automaton.end) and (got.moves == first.moves).all()
    assert np.allclose(model.background.pairs, want.background.pairs, atol=1e-4) and np.allclose(model.background.classes, want.background.classes, atol=1e-4)
    assert math.isclose(model.cut, max(0.0, secrets._tenth(want, sorted(kept)) / 2), rel_tol=1e-4)


def test_branches_tell_classes_apart():
    rng = random.Random(22)
    keys = ["".join(rng.choice("ABCDEFGH") for _ in range(4)) + "".join(rng.choice("0123456789") for _ in range(6)) for _ in range(200)]
    a = secrets.learn([k.encode() for k in keys])
    codes, ends = secrets.coded([b"ABCD123456", b"123456ABCD"])
    one, other = a.likelihoods(codes, ends)
    assert one > other + 10
