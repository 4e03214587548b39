"""Approximate nearest neighbours (largest cosine) by multi-index hashing of learned rotated binary codes.

Codes are signs after learned rotations (iterative quantisation on a bounded sample of `sample` vectors, several rotations
for more bits than dimensions). Codes are cut into substrings of 8 bits and every substring is indexed: codes at most r bits
apart agree in some substring up to r // substrings bits. Probing all values that near in every substring therefore
retrieves the whole ball. A query's radius grows until a block's ball holds `least` codes; everything in the ball
is ranked by the vectors themselves.

Every sound row is indexed: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
null ids; rows that share an id count once, with the smallest vector. Vectors of different lengths do not meet. Ties go
to the smaller id. Fewer than k candidates: all of them. Empty tables give no rows. Other columns do not take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm import blocks
from tilewright.llm.common import saved

BITS, BYTE = 256, 8
DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def learn(x: np.ndarray, bits: int = BITS, rounds: int = 25, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotations: dim x bits). Each rotation is turned so that the signs of the turned vectors lie as near to them as can be."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    centred = x - mean
    parts = []
    for _ in range(-(-bits // x.shape[1])):
        r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(centred.T @ np.sign(centred @ r))
            r = u @ v
        parts.append(r)
    return mean, np.concatenate(parts, axis=1)[:, : max(BYTE, bits // BYTE * BYTE)]


def code(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return np.packbits((x - mean) @ turn > 0, axis=1)


class Index:
    """A block's codes, indexed by each substring: for a substring's value and a radius, the rows whose substring is that near, as a bitmap."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.words, self.lists, self.last = codes, wide(codes), {}, 0

    def postings(self, radius: int) -> np.ndarray:
        if radius not in self.lists:
            near = DISTANCE <= radius
            self.lists[radius] = np.stack([np.packbits(near[:, c], axis=1) for c in self.codes.T])
        return self.lists[radius]

    def probe(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows that agree with the query in some substring up to `radius` bits."""
        hit = np.bitwise_or.reduce(self.postings(radius)[np.arange(len(query)), query], axis=0)
        return np.flatnonzero(np.unpackbits(hit, count=len(self.codes)))

    def ball(self, query: np.ndarray, least: int) -> np.ndarray:
        """All rows within the smallest radius that holds `least` of them (all rows, if there are fewer). Probing starts at the substring radius that the last query ended with."""
        m, want, word = len(query), min(least, len(self.codes)), wide(query[None])
        for radius in range(self.last, BYTE + 1):
            rows = self.probe(query, radius)
            far = np.bitwise_count(self.words[rows] ^ word).sum(axis=1, dtype=np.int64)
            if np.count_nonzero(far < m * (radius + 1)) >= want:
                break
        self.last = radius
        return rows[far <= np.partition(far, want - 1)[want - 1]]


def wide(codes: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words, filled up with zeros."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)


def nearest(embeddings: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", bits: int = BITS, least: int = 192, sample: int = 4096) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id satisfies `is_query` (a condition on column id), the k nearest other rows found."""
    vectors = blocks.sound(embeddings, id_col, vector).filter(F.exists("v", lambda x: x != 0))
    vectors = saved(vectors, "vectors")
    dealt, n = blocks.dealt(vectors, blocks.CANDIDATES, "block")
    asked, m = blocks.dealt(vectors.filter(is_query), blocks.QUERIES, "qblock")
    # A rotation for each dimension, learned on a sample of bounded size.
    # Some more than needed are told by a threshold of their hash, so that no task puts all vectors in order.
    share = F.least(F.lit(1.0), 1.25 * sample / F.col("_n") + 64 / F.col("_n"))
    near = vectors.join(vectors.groupBy("dim").agg(F.count("*").alias("_n")).hint("merge"), "dim").withColumn("_h", F.xxhash64("id", F.lit(3))).filter(F.col("_h") <= -(2.0**63) + share * 2.0**64)
    taken = near.withColumn("_r", F.row_number().over(Window.partitionBy("dim").orderBy("_h", "id"))).filter(F.col("_r") <= sample)
    by_dim: dict[int, list] = {}
    for r in taken.select("dim", "v").toLocalIterator():
        by_dim.setdefault(r["dim"], []).append(r["v"])
    turns = {d: learn(unit(np.array(v)), bits) for d, v in by_dim.items()}

    def made(t: pa.Table) -> pa.Table:
        x = blocks.matrix(t["v"])
        out = {c: t[c].slice(0, 1).combine_chunks() for c in ("block", "dim")}
        codes = code(unit(x), *turns[t["dim"][0].as_py()])
        return pa.table(out | {"ids": pa.array([t["id"].to_numpy()], pa.list_(pa.int64())), "v": pa.array([x.ravel()], pa.list_(pa.float64())), "codes": pa.array([codes.tobytes()], pa.binary())})

    index = saved(dealt.groupBy("block", "dim").applyInArrow(made, "block int, dim int, ids array<long>, v array<double>, codes binary"), "codes")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if a.num_rows and b.num_rows:
            ids = a["ids"].combine_chunks().flatten().to_numpy()
            x = a["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            index = Index(np.frombuffer(a["codes"][0].as_py(), np.uint8).reshape(len(ids), -1))
            size = norm(x)
            qid, q = b["id"].to_numpy(), blocks.matrix(b["v"])
            codes, long = code(unit(q), *turns[a["dim"][0].as_py()]), norm(q)
            for i in range(len(q)):
                rows = index.ball(codes[i], least)
                rows = rows[ids[rows] != qid[i]]
                score = cosine(x[rows], size[rows], q[i], long[i])
                best = np.lexsort((ids[rows], -score))[:k]
                for o, v in zip(out, (np.full(len(best), qid[i]), ids[rows][best], score[best]), strict=True):
                    o.append(v)
        return pa.table([pa.array(np.concatenate(o)) for o in out], names=["query_id", "id", "score"])

    found = blocks.met(index, n, asked, m, search, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def norm(x: np.ndarray) -> np.ndarray:
    """Lengths. Vectors are scaled by their largest component first, so that squares neither overflow nor vanish."""
    most = np.abs(x).max(axis=1)
    y = x / most[:, None]
    return most * np.sqrt((y * y).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    y = x / np.abs(x).max(axis=1)[:, None]
    return y / np.sqrt((y * y).sum(axis=1))[:, None]


def cosine(x: np.ndarray, size: np.ndarray, q: np.ndarray, long: float) -> np.ndarray:
    """Row by row, so that equal vectors get equal scores."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore", under="ignore"):
        out = (x * q).sum(axis=1) / (size * long)
    if not np.isfinite(out).all():
        out = (unit(x) * unit(q[None])).sum(axis=1)
    return out
