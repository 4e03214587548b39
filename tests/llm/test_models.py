"""Classifiers: held-out accuracy, edge cases, and brute force of what can be recomputed."""

import itertools
import math
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import labelled, licences, quality, toxicity

SF = "/root/testdata/sf0.1"
EDGES = [(None, "x"), (1, None), (2, ""), (3, "you idiot moron " * 5), (3, "you idiot moron " * 5), (4, "word " * 100_000)]


@pytest.fixture(scope="module")
def split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")


def edges(spark):
    return spark.createDataFrame([(i, t, True, 0.5) for i, t in EDGES], "doc_id long, text string, keep boolean, toxicity double")


def test_toxicity_on_held_out_rows(spark, split):
    docs, train, test = split
    chain = toxicity.fit(docs, train)
    got = toxicity.score(docs, chain).join(test, "doc_id").groupBy("toxic", "is_toxic").count().collect()
    n = {(r.toxic, r.is_toxic): r["count"] for r in got}
    assert n.get((0, True), 0) <= 0.005 * n[(0, False)] and n[(1, True)] >= 0.8 * (n[(1, True)] + n.get((1, False), 0))
    out = toxicity.score(edges(spark), chain).collect()
    assert len(out) == len(EDGES) and [r.is_toxic for r in out if r.doc_id == 3] == [True, True] and not any(r.is_toxic for r in out if r.doc_id in (1, 2, 4))
    assert toxicity.score(edges(spark).limit(0), chain).count() == 0


def test_toxicity_without_labels(spark, split):
    docs, train, _ = split
    for labels in (train.limit(0), train.filter("toxic = 0"), train.select("doc_id", F.lit(None).cast("int").alias("toxic"))):
        assert not any(r.is_toxic for r in toxicity.score(edges(spark), toxicity.fit(docs, labels)).collect())


def test_chain_uses_out_of_fold_predictions():
    """A later link sees the earlier category only through its probabilities."""
    rng = np.random.default_rng(0)
    first = rng.random(400) < 0.3
    row = np.concatenate([np.flatnonzero(first), np.arange(400)])
    bucket = np.concatenate([np.full(first.sum(), 5), rng.integers(10, 400, 400)])
    chain = toxicity.fit_chain(row, bucket, [first, first])
    assert 5 in chain[0].buckets and len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0
    p = toxicity.apply_link(chain[0], row, bucket, np.zeros((400, 0)))
    assert ((p > 0.5) == first).mean() > 0.97


def slow_hash(word, bits, seed=21):
    """A bucket by the formula, in plain numbers."""
    h = labelled.hasher(seed)
    low = (1 << 64) - 1
    x = (sum(int(h.byte[c]) * pow(h.powers.base, k, 1 << 64) for k, c in enumerate(word)) + len(word)) & low
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & low
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & low
    return (x ^ (x >> 31)) >> (64 - bits)


def test_toxicity_is_what_its_weights_say(spark, split):
    """Probabilities of whole texts, recomputed word by word."""
    docs, train, _ = split
    chain = toxicity.fit(docs, train)
    for r in toxicity.score(docs.filter("doc_id % 250 = 1"), chain).join(docs, "doc_id").collect():
        words = re.findall(rb"[a-z\x80-\xff]+", r.text.encode().lower())
        has = {slow_hash(w[:n], toxicity.BITS) for w in words for n in (4, 5, 6, 7, len(w))}
        p = []
        for link in chain:
            x = link.constant + sum(float(v) for b, v in zip(link.buckets, link.weights) if int(b) in has) + sum(float(a) * b for a, b in zip(link.earlier, p))
            p.append(1 / (1 + math.exp(-max(-35, min(35, x)))))
        assert [r.p_group_1, r.p_group_2, r.toxicity] == pytest.approx(p, abs=1e-9) and r.is_toxic == (p[-1] >= 0.5)


def test_quality_is_what_its_weights_say(spark, split):
    """Expected grades and tail probabilities of whole texts, recomputed word by word."""
    docs, train, _ = split
    model = quality.fit(docs, quality.grades(train))
    kind = lambda c: 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c
    for r in quality.score(docs.filter("doc_id % 250 = 1"), model).join(docs, "doc_id").collect():
        words, n = r.text.encode().split(), {}
        for k, w in enumerate(words):
            shape = bytes(g for g, _ in itertools.groupby(map(kind, w)))
            for b in (slow_hash(w, quality.BITS, 22), slow_hash(shape, quality.BITS, 23), *([0] if k and words[k - 1] == w else [])):
                n[b] = n.get(b, 0) + 1
        x = sum(float(model.weights[b]) * math.sqrt(c / len(words)) for b, c in n.items())
        tails = [1 / (1 + math.exp(-max(-35, min(35, x - t)))) for t in model.thresholds]
        assert [r.expected_grade, r.tail_probability] == pytest.approx([sum(tails), tails[0]], abs=1e-6)


def test_quality_on_held_out_rows(spark, split):
    docs, train, test = split
    model = quality.fit(docs, quality.grades(train))
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score(docs, model).join(test, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r.quality, r.keep): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)] and n[(0, False)] >= 0.9 * (n[(0, False)] + n.get((0, True), 0))
    out = quality.score(edges(spark), model).collect()
    assert len(out) == len(EDGES) and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    assert quality.score(edges(spark).limit(0), model).count() == 0
    assert all(r.keep for r in quality.score(edges(spark), quality.fit(docs, quality.grades(train).limit(0))).collect())


def test_ordinal_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=600)
    y = np.digitize(x + 0.1 * rng.normal(size=600), [-0.5, 0.7])
    m = quality.fit_ordinal(np.arange(600), np.zeros(600, int), x, y, 1)
    assert m.weights[0] > 1 and m.thresholds[0] / m.weights[0] == pytest.approx(-0.5, abs=0.2) and m.thresholds[1] / m.weights[0] == pytest.approx(0.7, abs=0.2)


def test_shapes_ignore_batches():
    import pyarrow as pa

    from tilewright.llm import bytesvec as V

    texts = ["AAA!! bb%% bb%%", "", "é1 x"]
    alone = [sorted(zip(*[x.tolist() for x in quality.counted(*next(iter(V.runs(pa.array([t]))))[1:])])) for t in texts]
    row, bucket, value = quality.counted(*next(iter(V.runs(pa.array(texts))))[1:])
    assert alone == [sorted((0, int(b), float(v)) for r, b, v in zip(row, bucket, value) if r == i) for i in range(3)]


def brute_licences(text):
    """Paragraphs cut by hand, all words of a paragraph at once, families found one after another."""
    m = licences.model()
    at = {g: i for i, g in enumerate(m["grams"])}
    of = {f: {p for t in ts for p in licences.template_pairs(t)} for f, ts in licences.TEMPLATES.items()}
    out = []
    for k, para in enumerate(re.split(licences.BLANK_LINES, re.sub(licences.MARKS, "", text or ""))):
        w = licences.words_of(para)
        left, removed = {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}, set()
        while True:
            z = np.round(sum((m["weights"][at[g]] for g in left if g in at), np.zeros(len(m["families"]))), 6) + m["constant"]
            taken = set().union(*(of[f] for f in removed)) if removed else set()
            best = None
            for i, f in enumerate(m["families"][:-1]):
                pairs = [[p for p in licences.template_pairs(t) if p not in taken] for t in licences.TEMPLATES[f]]
                share = max((sum(p in left for p in ps) / len(ps) for ps in pairs if ps), default=0)
                if f not in removed and share >= licences.SHARE and (best is None or z[i] > z[best]):
                    best = i
            if best is None or 1 / (1 + math.exp(z[-1] - z[best])) < licences.SURE:
                break
            removed.add(m["families"][best])
            left -= of[m["families"][best]]
        out += [(k, f) for f in sorted(removed)]
    return out


def wrapped(text, mark="", width=60):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


MIT = licences.TEMPLATES["MIT"][4]
NOTICES = {"MIT": wrapped(MIT), "ISC": wrapped(licences.TEMPLATES["ISC"][2], "// "), "GPL-3.0": "/*\n" + wrapped(licences.TEMPLATES["GPL-3.0"][3], " * ") + "\n */", "Apache-2.0": wrapped(licences.TEMPLATES["Apache-2.0"][3], "# ", 72), "BSD-3-Clause": wrapped(licences.TEMPLATES["BSD-3-Clause"][3], "    ", 40), "LGPL-3.0": wrapped(licences.TEMPLATES["LGPL-3.0"][3], "-- "), "EPL-2.0": wrapped(licences.TEMPLATES["EPL-2.0"][2], "; "), "Unlicense": wrapped(licences.TEMPLATES["Unlicense"][2])}


def test_licences(spark):
    texts = [t for ts in licences.TEMPLATES.values() for t in ts] + list(licences.OTHERS) + [None, "", "plain\n\nReleased under the MIT License.\n\nAll rights reserved.", "word " * 50_000 + "\n\nLicensed under CC BY-NC 4.0.", "MIT " * 20, "Licensed under the Apache License, Version 2.0." * 2]
    texts += [f"A line of code.\n\n{t}\n\nAnother one." for t in NOTICES.values()] + ["This software is dual-licensed under the MIT License and the Apache License, Version 2.0, as you like."]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "Released under the MIT License.", "x", 1)], "doc_id long, text string, hits string, paragraph int")
    got = {r.doc_id: [(h.paragraph, h.family) for h in r.hits] for r in licences.scan(df).collect()}
    assert got == {i: brute_licences(t) for i, t in enumerate(texts)} | {None: [(0, "MIT")]}
    for i, (f, t) in enumerate((f, t) for f, ts in licences.TEMPLATES.items() for t in ts):
        assert f in [x for _, x in got[i]], t
    n = sum(map(len, licences.TEMPLATES.values()))
    assert not any(got[n + i] for i in range(len(licences.OTHERS)))
    for i, f in enumerate(NOTICES):
        assert (1, f) in got[len(texts) - 1 - len(NOTICES) + i], f
    assert {f for _, f in got[len(texts) - 1]} == {"MIT", "Apache-2.0"}
    assert licences.scan(df.limit(0)).count() == 0


def test_long_paragraphs_are_judged_in_parts(spark):
    """A notice anywhere in a paragraph of thousands of words."""
    prose = " ".join(f"w{k}" for k in range(3000)).split()
    rows = [(k, " ".join(prose[:at] + MIT.split() + prose[at:])) for k, at in enumerate((0, 100, 255, 1000, 2999))]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [list(r.licences) for r in got] == [["MIT"]] * 5


def test_plain_texts_state_no_licence(spark, split):
    """Precision on invented prose: of texts without a word of licences nothing is named."""
    docs = split[0].filter("doc_id < 3000")
    plain = docs.filter(~F.lower("text").rlike("licen[sc]e|copyright|spdx|rights reserved|public domain|free software|gnu |redistribut|permission"))
    assert plain.count() > 500 and licences.scan(plain).filter("n_hits > 0").count() == 0


def test_licence_scan_is_native(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licences.scan(df)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_sample_is_bounded(spark, split):
    docs, train, _ = split
    rows = labelled.sample(docs, train.unionByName(train), ["toxic"], 50)
    assert rows.count() == 50 and sorted(r._text for r in rows.collect()) == sorted(r._text for r in labelled.sample(docs, train, ["toxic"], 50).collect())
