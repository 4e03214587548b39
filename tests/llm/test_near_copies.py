"""The pipeline's near-dedup stage against a brute force of five-word Jaccard similarity."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from test_text import brute_fingerprint, classes  # noqa: E402

from tilewright.llm import jaccard  # noqa: E402

SF, SCHEMA = "/root/testdata/sf0.001", "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    if x and y and min(len(x), len(y)) < 0.8 * max(len(x), len(y)):
        return False
    return not x and not y or len(x & y) >= 0.8 * len(x | y)


def brute_alike(s, t):
    return alike(shingle_set(s), shingle_set(t))


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def brute_kept(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    sets = [shingle_set(t) for _, t in rows]
    ids = range(len(rows))
    of = classes(ids, [(a, b) for a in ids for b in ids if b < a and ((fps[a] ^ fps[b]).bit_count() <= 3 or alike(sets[a], sets[b]))])
    heads = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            heads[of[k]] = min(heads.get(of[k], (i, k)), (i, k))
    return sorted([k for _, k in heads.values()] + [k for k, (i, _) in enumerate(rows) if i is None])


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, str(k), "s", 0) for k, (i, t) in enumerate(rows)], SCHEMA).coalesce(1)
    return sorted(int(r.lang) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())


def test_short_near_copies_go(spark):
    rng = random.Random(3)
    rows = []
    for k, n in enumerate([30, 60, 60, 100, 100, 100, 150, 300, 600, 2000]):
        words = [f"w{rng.randrange(10**5)}" for _ in range(n)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, changed(rng, words, 1)), (10 * k + 2, changed(rng, words, n // 4))]
    assert kept(spark, rows) == brute_kept(rows) == [k for k in range(30) if k % 3 != 1 or brute_alike(rows[k][1], rows[k - 1][1]) is False]


def test_rows_that_share_an_id_stay(spark):
    rows = [(1, "one text of its own that nothing else is like"), (1, "another text under the same number, not like the first"), (2, None), (2, ""), (None, "one text of its own that nothing else is like")]
    assert kept(spark, rows) == brute_kept(rows) == [0, 1, 2, 4]


def test_large_bands_are_connected(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, changed(rng, words, 1)) for k in range(60)] + [(100, " ".join(words[:60]))]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "_row long, text string")
    nodes, links = jaccard.links(docs, small=8)
    found = [(r.a, r.b) for r in links.collect()]
    assert nodes.count() == 61 and len(found) < 60 * 59 // 2 and all(brute_alike(dict(rows)[a], dict(rows)[b]) for a, b in found)
    assert set(classes(range(60), found).values()) == {0}
    assert kept(spark, rows) == [0, 60]


def test_variants_of_one_text_are_connected(spark):
    """Texts that are like a common one, but mostly not like each other."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, changed(rng, words, 5)) for k in range(40)] + [(500, " ".join(words))]
    assert kept(spark, rows) == brute_kept(rows) == [0]


def test_links_through_others_are_not_lost(spark):
    """One text, a hundred that differ from it in a word, and of each of these one that differs in four more: those are like it, and not like the first."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(204)]
    rows = [(0, " ".join(base))]
    for k in range(100):
        near = changed(rng, base, 1)
        rows += [(2 * k + 1, near), (2 * k + 2, changed(rng, near.split(), 4))]
    assert kept(spark, rows) == brute_kept(rows)


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_families_of_any_size_are_connected_as_by_all_pairs(spark, block):
    rng = random.Random(9)
    rows = []
    for f in range(3):
        base = [f"f{f}w{k}" for k in range(150)]
        rows += [(len(rows), " ".join(base))] if f else []
        for _ in range(25):
            rows.append((len(rows), changed(rng, base, rng.choice([1, 2, 4, 8]))))
            if rng.random() < 0.4:
                rows.append((len(rows), changed(rng, rows[-1][1].split(), 3)))
    sets = [shingle_set(t) for _, t in rows]
    docs = spark.createDataFrame(rows, "_row long, text string")
    nodes, links = jaccard.links(docs, small=2, block=block)
    found = {(r.a, r.b) for r in links.collect()}
    n = range(len(rows))
    assert all(alike(sets[a], sets[b]) for a, b in found)
    want = classes(n, [(a, b) for a in n for b in n if b < a and alike(sets[a], sets[b])])
    assert classes(n, list(found)) == want and len(set(want.values())) > 3


def test_recall_of_pairs_at_the_threshold(spark):
    """Of pairs of 0.8 to 0.85, each alone, 99 in 100 at least are found."""
    rng = random.Random(10)
    rows, pairs = [], set()
    for k in range(400):
        words = [f"p{k}w{j}" for j in range(200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, changed(rng, words, 4))]
        if 0.8 <= len(shingle_set(rows[-1][1]) & shingle_set(rows[-2][1])) / len(shingle_set(rows[-1][1]) | shingle_set(rows[-2][1])):
            pairs.add((2 * k, 2 * k + 1))
    found = {(r.a, r.b) for r in jaccard.links(spark.createDataFrame(rows, "_row long, text string"))[1].collect()}
    assert found <= pairs and len(found) >= 0.99 * len(pairs) > 100


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a b", "x")], "_row long, text string, node string")
    nodes, links = jaccard.links(docs)
    assert {(r["_row"], r.node) for r in nodes.collect()} == {(1, 1), (2, 1), (3, 3)} and links.count() == 0
    nodes, links = jaccard.links(docs.limit(0))
    assert nodes.count() == links.count() == 0
