"""Exact and approximate search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import blocks, hashindex, vafile

SCHEMA = "vec_id long, embedding array<float>, id string, v int, block int"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:400] = x[100]  # copies
    x[400:420] = 0
    return [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(1000, None), (1050, []), (1100, [float("nan")] * 16), (1150, [None] + [0.5] * 15), (1200, [1.0] * 3), (1250, [2.0, 0.0, 1.0]), (None, [1.0] * 16), (50, [9.0] * 16)]


def frame(spark, data):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in data], SCHEMA)


def sound(data):
    out = {}
    for i, v in data:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (i not in out or v < out[i]):
            out[i] = v
    return {i: np.array(v, np.float32).astype(np.float64) for i, v in out.items()}


def test_exact_top_k(spark, data, monkeypatch):
    monkeypatch.setattr(blocks, "CANDIDATES", 64)
    monkeypatch.setattr(blocks, "QUERIES", 5)
    rows = {i: np.floor(256 * v).astype(np.int64) for i, v in sound(data).items()}
    want = set()
    for q in rows:
        if q % 50 == 0:
            best = sorted((-int(rows[q] @ v), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r)[:4] for r in vafile.top_k(frame(spark, data), F.col("id") % 50 == 0).collect()} == want
    assert vafile.top_k(frame(spark, data).limit(0), F.col("id") % 50 == 0).count() == 0


def test_bounds_hold():
    """Bounds of components of any size hold, and are exact where all sums are whole numbers of doubles."""
    rng = np.random.default_rng(4)
    for size in (1e2, 1e8, 1e20, 1e200, 1e300):
        q, low = np.floor(rng.normal(size=(5, 8)) * size), np.floor(rng.normal(size=(6, 8)) * size)
        high = low + np.floor(rng.random((6, 8)) * size)
        x = np.floor(low + (high - low) / 2)
        least, most = vafile.bounds_of(q, low, high)
        for i in range(5):
            for j in range(6):
                s = sum(int(a) * int(b) for a, b in zip(q[i], x[j]))
                assert least[i, j] <= vafile.double(s) <= most[i, j]
        if size == 1e2:
            same = vafile.bounds_of(q, low, low)
            assert (same[0] == q @ low.T).all() and (same[1] == same[0]).all()


def test_large_components(spark):
    """Scores are exact where they leave doubles, and where they leave 64 bits."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 6))
    x[:20] *= 1e7
    x[20:40] *= 1e18
    x[40:50] *= 1e300
    x[50:60] = x[20]
    data = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(90, [1e308] * 6), (100, [1.7e308] + [0.0] * 5)]
    rows = {i: [int(256 * a // 1) for a in v] for i, v in data if all(abs(256 * a) < float("inf") for a in v)}
    want = set()
    for q in (q for q in rows if q % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s if -(1 << 63) <= -s < 1 << 63 else None, None if -(1 << 63) <= -s < 1 << 63 else str(-s)) for k, (s, i) in enumerate(best)}
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in vafile.top_k(df, F.col("id") % 10 == 0).collect()} == want


def test_nearest(spark, data, monkeypatch):
    monkeypatch.setattr(blocks, "CANDIDATES", 128)
    rows = {i: v for i, v in sound(data).items() if np.abs(v).max() > 0}
    got = {}
    for r in hashindex.nearest(frame(spark, data), F.col("id") % 50 == 0, least=64).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    unit = {i: v / np.linalg.norm(v) for i, v in rows.items()}
    hit = total = 0
    for q in (q for q in unit if q % 50 == 0):
        others = sorted((-float(unit[q] @ v), i) for i, v in unit.items() if i != q and len(v) == len(unit[q]))[:5]
        for k, (v, s) in got.get(q, {}).items():
            assert abs(s - unit[q] @ unit[v]) < 1e-12
        scores = [got[q][k][1] for k in sorted(got.get(q, {}))]
        assert scores == sorted(scores, reverse=True)
        hit += sum(s >= -others[-1][0] - 1e-12 for s in scores)
        total += len(others)
    assert hit >= 0.9 * total
    assert hashindex.nearest(frame(spark, data).limit(0), F.col("id") % 50 == 0).count() == 0


def test_ball_is_whole():
    """Probing by the pigeonhole rule finds every code within the radius."""
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    index = hashindex.Index(codes)
    for q in rng.integers(0, 256, (20, 8), dtype=np.uint8):
        far = np.bitwise_count(codes ^ q).sum(axis=1)
        r = np.sort(far)[29]
        assert sorted(index.ball(q, 30)) == sorted(np.flatnonzero(far <= r))
