"""Encoding, packing, substring and near-duplicate removal against brute force."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402
import xxhash  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tilewright.llm import bpe, graph, packing, simhash, substring  # noqa: E402

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, _row int, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aab  \n\t é漢'slltd1٣.!　\x85x😀"), max_size=30))
def test_encoder_matches_the_reference_library(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))} if not hasattr(test_encoder_matches_the_reference_library, "e") else None
    if ranks:
        test_encoder_matches_the_reference_library.e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = test_encoder_matches_the_reference_library.e.encode_ordinary(text)
    assert np.frombuffer(bpe.encoder(RANKS, P.PATTERN)(text), "<u4").tolist() == want
    assert np.frombuffer(bpe.encoder(JSON)(text), "<u4").tolist() == want


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n", "<|endoftext| >", "é <|endoftext|>漢"])
def test_added_tokens_are_found_as_the_library_does(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.encoder(JSON)(text), "<u4").tolist() == want
    plain = test_encoder_matches_the_reference_library.e.encode_ordinary(text) if hasattr(test_encoder_matches_the_reference_library, "e") else None
    assert plain is None or np.frombuffer(bpe.encoder(RANKS, P.PATTERN)(text), "<u4").tolist() == plain


def rows(*texts):
    return [(i, t, "x", 7, "s") for i, t in enumerate(texts)]


def test_encode_decode_round_trip(spark, reference):
    long = "word " * 20000 + "é漢😀" * 3000
    texts = [None, "", " ", "Hello, world. It's 1999", "😀😀 ñ\n\n  end ", long, "<|endoftext|>"]
    df = spark.createDataFrame(rows(*texts), SCHEMA)
    out = bpe.encode(df, RANKS, pattern=P.PATTERN, offsets=True)
    assert out.columns == ["doc_id", "text", "_row", "source", "ids", "offsets"]  # a clashing column is replaced
    for r in bpe.decode(out, RANKS, pattern=P.PATTERN).collect():
        t = texts[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(t) and r.decoded_text == t and bytes(r.decoded) == t.encode()
        for (a, b), i in list(zip(r.offsets, r.ids))[:50]:
            piece = bpe.token_bytes(RANKS, P.PATTERN)[i]
            assert piece in t[a:b].encode()
    half = spark.createDataFrame([(1, reference.encode_ordinary("😀")[:1])], "doc_id long, ids array<int>")
    r = bpe.decode(half, RANKS, pattern=P.PATTERN).first()
    assert "�" in r.decoded_text and "😀".encode().startswith(bytes(r.decoded))
    assert bpe.digests(df.limit(0), RANKS, pattern=P.PATTERN).count() == 0
    for r in bpe.digests(df, RANKS, pattern=P.PATTERN).collect():
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_pieces_and_packing(spark, reference):
    rng = random.Random(3)
    texts = [None, "", "x"] + [" ".join("abcdefgh"[rng.randrange(8)] * rng.randrange(1, 5) for _ in range(rng.choice([3, 40, 900, 4500]))) for _ in range(120)]
    df = spark.createDataFrame(rows(*texts) + [(None, "x", "x", 7, "s"), (2, "x", "x", 7, "s")], SCHEMA)
    got = packing.pack(packing.pieces(df, JSON)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[(r.doc_id, r.piece)].append(r)
    for i, t in enumerate(texts):
        ids = [*reference.encode_ordinary(t or ""), 0]
        cut = [len(ids)] if len(ids) <= 2048 else list(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048))
        for k, (a, b) in enumerate(zip([0, *cut], cut)):
            r = by[(i, k)][0]
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        v.sort()
        assert v[0][0] == 0 and sum(n for _, n in v) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:]))
    assert len(got) == sum(len(v) for v in seqs.values()) and len([r for r in got if r.doc_id == 2]) == 2
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) * 1.05 + 1
    assert packing.pack(packing.pieces(df.limit(0), JSON)).count() == 0


def test_packing_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(k, 300 * k, "r", "o", 5) for k in range(9)], "doc_id long, length long, _row string, Offset string, _shard long")
    out = packing.pack(df)
    assert sorted(out.columns) == ["_row", "_shard", "doc_id", "length", "offset", "sequence_id"]
    got = {r.doc_id: r for r in out.collect()}
    assert all((r._row, r._shard) == ("r", 5) for r in got.values()) and got[0].sequence_id is None and got[7].sequence_id is None and got[3].offset is not None


def test_squares_rule():
    """Each item goes where the sum of squared counts of gaps becomes smallest."""
    rng = np.random.default_rng(1)
    items = rng.integers(1, 31, 200)
    where, at = packing.squares_pack(items, 30)
    gaps, used = collections.Counter(), []
    for s, w, o in zip(items, where, at):
        best = {}
        for g in {g for g in gaps if gaps[g] and g >= s} | {30}:
            c = gaps.copy()
            if g < 30:
                c[g] -= 1
            if g - s:
                c[g - s] += 1
            best[g] = sum(v * v for v in c.values())
        gap = 30 if w == len(used) else 30 - used[w]
        assert best[int(gap)] == min(best.values())
        if w == len(used):
            used.append(0)
        assert used[w] == o
        if gap < 30:
            gaps[int(gap)] -= 1
        used[w] += int(s)
        if used[w] < 30:
            gaps[30 - used[w]] += 1


def brute_substring(docs, width):
    seen, out = {}, collections.defaultdict(list)
    order = sorted(((1 << 63) - 1 if i is None else i, k) for k, (i, _) in enumerate(docs))
    words = [WORD.findall(t or "") for _, t in docs]
    for i, k in order:
        for a in range(len(words[k]) - width + 1):
            w = tuple(words[k][a : a + width])
            seen[w] = min(seen.get(w, (i, a)), (i, a))
    for i, k in order:
        gone = set()
        for a in range(len(words[k]) - width + 1):
            if seen[tuple(words[k][a : a + width])] < (i, a):
                gone.update(range(a, a + width))
        kept = " ".join(w for j, w in enumerate(words[k]) if j not in gone)
        out[docs[k][0]].append((len(words[k]), len(gone), kept))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("width", [3, 20])
def test_substring(spark, width):
    rng = random.Random(width)
    passage = " ".join(f"p{rng.randrange(99)}" for _ in range(60))
    texts = [(i, " ".join(rng.choice(["a", "b", "é x", "d.", passage]) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    docs = texts + [(5, texts[5][1]), (6, texts[9][1]), (None, passage), (None, None), (900, None), (901, ""), (902, "same " * 50), (903, " \t\n same\vsame\fsame\rsame ")]
    df = spark.createDataFrame([(i, t, "x", 7, "s") for i, t in docs], SCHEMA)
    got = collections.defaultdict(list)
    for r in substring.deduplicated(df, width=width, carry=("source", "_row")).collect():
        assert r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() and (r.source, r._row) == ("s", 7)
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept))
    assert {k: sorted(v) for k, v in got.items()} == brute_substring(docs, width)
    assert substring.deduplicated(df.limit(0), width=width).count() == 0


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_that_collide_under_powers(spark):
    """Words of two letters in Thue-Morse order and their complements have equal sums of powers of any odd number: they are no repeats."""
    same = " ".join(f"w{k}" for k in range(19))
    docs = [(k, f"{same} {thue_morse(1 << k, *ab)}") for k in range(4, 13) for ab in ("ab", "ba")]
    two = " ".join(thue_morse(256, "x", "y"))
    docs += [(100, two), (101, two.translate(str.maketrans("xy", "yx")))]
    df = spark.createDataFrame([(i, t, "x", 7, "s") for i, t in docs], SCHEMA)
    got = collections.defaultdict(list)
    for r in substring.deduplicated(df).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept))
    assert {k: sorted(v) for k, v in got.items()} == brute_substring(docs, 20)


def test_windows_that_share_a_hash_are_found_out(spark):
    """With few bits of hash every try finds windows that differ; with some more a later try is right."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60))) for i in range(12)] + [(i + 20, "same words again " * 9 + str(i)) for i in range(3)]
    df = spark.createDataFrame([(i, t, "x", 7, "s") for i, t in docs], SCHEMA)
    with pytest.raises(RuntimeError):
        substring.deduplicated(df, width=3, strength=4)
    got = collections.defaultdict(list)
    for r in substring.deduplicated(df, width=3, strength=40).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept))
    assert {k: sorted(v) for k, v in got.items()} == brute_substring(docs, 3)


def test_small_sketch_changes_nothing(spark):
    docs = [(i, f"{'x y z ' * 9} {i} " + " ".join(str(i * 7 + k) for k in range(40))) for i in range(40)]
    df = spark.createDataFrame([(i, t, "x", 7, "s") for i, t in docs], SCHEMA)
    want = sorted((r.doc_id, r.kept_sha256) for r in substring.deduplicated(df, most_counters=1 << 28).collect())
    assert want == sorted((r.doc_id, r.kept_sha256) for r in substring.deduplicated(df, most_counters=1 << 16).collect())


def brute_fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = WORD.findall(t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, near):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in near:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    texts = []
    for i in range(120):
        w = list(base) if i % 3 else [f"v{rng.randrange(900)}" for _ in range(rng.randrange(0, 80))]
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "Édit" if w else ""
        texts.append(" ".join(w)) if w else texts.append("")
    texts += [None, "", "One", "one TWO", "É two three"]
    df = spark.createDataFrame(rows(*texts), SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = classes(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}
    nulls = spark.createDataFrame([(None, "a b c", "x", 7, "s"), (4, "a b c", "x", 7, "s"), (4, "a b c", "x", 7, "s")], SCHEMA)
    assert sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(nulls).collect()) == [("4", 4), ("4", 4), ("None", 4)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_links_of_dense_groups(spark, block):
    """Dense groups, and keys with more fingerprints than a block holds, keep all that is connected."""
    rng = random.Random(block)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(120):
            x = centre
            for _ in range(rng.randrange(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = [(r.a, r.b) for r in simhash.links(df, block=block).collect()]
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert all(apart(a, b) <= 3 for a, b in got)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if apart(a, b) <= 3]
    assert classes(fps, got) == classes(fps, near)
    found = {r.node: r.component for r in graph.components(simhash.links(df, block=block)).collect()}
    want = classes(fps, near)
    assert all(found.get(n, n) == want[n] for n in fps)


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    want = classes({n for l in links for n in l}, links)
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {n: c for n, c in want.items() if n in {x for a, b in links if a != b for x in (a, b)}}
    assert graph.components(df.limit(0)).count() == 0
    few = {b for _, b in links if b < 3}
    got = {(r.node, r.component) for r in graph.components(df.select(F.lit(1).cast("long").alias("a"), "b").filter("b < 3")).collect()}
    assert got == ({(n, min(few | {1})) for n in few | {1}} if few - {1} else set())
