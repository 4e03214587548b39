"""Lexical search and decontamination against brute force."""

import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
from tilewright.llm import decontaminate, lexical  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = {k: k + 32 for k in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(A_TO_Z))


def brute_ranks(docs, items, k=10):
    own = [(i, Counter(words(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        found = []
        for at, (i, c, n) in enumerate(own):
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score:
                found.append((-score, i is None, i or 0, at, i))
        out += [(item, r, x[4], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return out


def made(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(4000)] + ["É", "é", "Straße", "X9", "漢字"]
    docs = [(i, made(rng, vocabulary, rng.choice([1, 5, 40, 300]))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "..., !"), (7, docs[7][1]), (None, docs[3][1]), (303, "w1 " * 70_000), (304, "the-É_the"), (305, "rare")]
    items = [(k, made(rng, vocabulary, 25)) for k in range(12)] + [(50, None), (51, "?"), (52, "nowhere at all"), (53, docs[3][1]), (53, "rare rare RARE"), (None, "é É")]
    return docs, items


@pytest.mark.parametrize("most", [30, 1 << 17])
def test_search(spark, most):
    docs, items = corpus(1)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, n int").repartition(3)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, id string")
    got = [tuple(r) for r in lexical.search(lexical.index(d), q, most=most).collect()]
    # Repeated documents may change places.
    assert sorted(map(repr, got)) == sorted(map(repr, brute_ranks(docs, items)))
    assert lexical.search(lexical.index(d.limit(0)), q).count() == 0 and lexical.search(lexical.index(d), q.limit(0)).count() == 0


def test_bounds_hold():
    import numpy as np

    rng = random.Random(4)
    text = made(rng, [f"v{k}" for k in range(60)], 400)
    data = np.frombuffer(text.encode(), np.uint8)
    h, place, row = lexical.terms(data, np.array([0, len(data)]))
    _, h1, count, one = lexical.counted(h, row)
    other = lexical.second(data, place[one])
    block = lexical.Block([(k, int(a), int(b), 10 + k) for k in range(3) for a, b in zip(h1.view(np.int64)[k::3], other.view(np.int64)[k::3])] + [(1, 5, 5, 1000)])
    for bits in (6, 9):  # 6: many terms share a cell
        sketch = np.zeros((1, 2 << bits), np.uint8)
        for line, cell in enumerate(lexical.cells(h1, bits)):
            np.maximum.at(sketch[0], line * (1 << bits) + cell, np.minimum(count, lexical.MANY).astype(np.uint8))
        bound, score = block.bounds(sketch, bits, np.array([90]))[0], block.scores(text, 90)
        assert (bound >= score).all() and score.any()
    assert (bound[[0, 2]] <= score[[0, 2]] * 1.0001).all()


def brute_hits(docs, items, width=10):
    wins = {}
    for i, t in items:
        w = [x.translate(A_TO_Z) for x in words(t)]
        for k in range(max(1, len(w) - width + 1)) if w else []:
            wins.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (who := wins.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    names |= who
        own = sorted({str(n) for n in names if n is not None})
        out.append((i, len(w), len(hit), len(own), own, bool(hit)))
    return out


@pytest.mark.parametrize("most", [0, 10_000])
def test_decontamination(spark, most):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "é", "ΑΣ", "ας", "İx"]
    items = [(k, made(rng, vocabulary, rng.choice([3, 9, 10, 11, 30]))) for k in range(15)] + [(20, "the the the the the the the the the the the the"), (21, None), (22, "-"), (23, "ΑΣ'Β one"), (None, "nobody owns this"), (9, "solo")]
    docs = []
    for i in range(120):
        parts = [made(rng, vocabulary, rng.choice([0, 4, 20]))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").upper().split()
            a = rng.randrange(max(1, len(w) - 9))
            parts += [", ".join(w[a : a + rng.choice([9, 10, 14, 40])]), made(rng, vocabulary, 3)]
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "!!"), (5, docs[5][1]), (None, items[0][1]), (203, "the " * 40_000), (204, "Nobody owns THIS!"), (205, "solo"), (206, ".solo."), (207, "ας'β one"), (208, "ΑΣ'Β ONE")]
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, win string, _row int, items int").repartition(3)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, token string")
    got = [tuple(r) for r in decontaminate.scan(d, q, most_sent=most).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_hits(docs, items)))
    assert sum(r[5] for r in got) > 40
    assert decontaminate.scan(d.limit(0), q).count() == 0
    assert not any(r.n_hit for r in decontaminate.scan(d, q.limit(0)).collect())
