"""Exact top-k inner products with vector-approximation files.

Components are whole numbers floor(scale * x), kept as doubles, which hold them exactly. A block's approximation file has one byte a
component: the cell of the block's own cell borders. Scanning cells gives each candidate a lower and an upper bound of its score.
Candidates whose upper bound is below the k-th largest lower bound of the query are out. Exact vectors are then read in bound order, in
two rounds: the k most promising of a query, which settle how good the rest must be; then those of the rest whose bound still reaches that
score. What is not read cannot be among the k.

Sums are exact at any size: in doubles where no sum can leave their whole numbers, in 64-bit numbers where it cannot leave those, and else
in Python's own whole numbers; bounds of large components are widened by what rounding may have taken. `score` is null where it does not
fit 64 bits; `large_score` is then its decimal text (and null for all other rows). Ranks are by the exact score either way.

Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; rows that share an id
count once, with the smallest vector. Components that are finite but not so once scaled take their vector out as well. Vectors of different
lengths do not meet. Of equal vectors in a block only the k + 1 smallest ids can be among a query's k, and only they go on, so copies in any
number do not add up. Ties go to the smaller id. Fewer than k candidates: all of them. Empty tables give no rows. Other columns do not
take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm import blocks
from tilewright.llm.common import saved

CELLS, WHOLE, LONG, LARGE = 64, 2.0**53, 2.0**63, 2.0**62
#: Digits that the largest sums of products of doubles have.
DIGITS = 660


def build(vectors: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row for each (block, dim) of vectors (id, v: array<double>, dim, block): ids, copy (how many equal vectors of the block have a
    smaller id), the least and greatest value of each cell, and the cells."""

    def made(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x = blocks.matrix(t["v"])[order]
        _, same = np.unique(x, axis=0, return_inverse=True)
        same = same.reshape(-1)
        by = np.argsort(same, kind="stable")
        head = np.concatenate([[0], np.flatnonzero(np.diff(same[by])) + 1])
        copy = np.empty(len(x), np.int64)
        copy[by] = np.arange(len(x)) - np.repeat(head, np.diff([*head, len(x)]))
        cell = np.empty(x.shape, np.uint8)
        low, high = (np.zeros((x.shape[1], cells)) for _ in range(2))
        for d in range(x.shape[1]):
            values = np.sort(x[:, d])
            border = np.unique(values[np.arange(1, cells) * len(values) // cells])
            cell[:, d] = at = np.searchsorted(border, x[:, d], "right")
            for bound, pick, start in ((low, np.minimum, np.inf), (high, np.maximum, -np.inf)):
                row = np.full(cells, start)
                pick.at(row, at, x[:, d])
                bound[d] = np.where(np.bincount(at, minlength=cells) > 0, row, 0)
        out = {"block": t["block"].slice(0, 1).combine_chunks(), "dim": t["dim"].slice(0, 1).combine_chunks()}
        out |= {k: pa.array([v], pa.list_(t_)) for k, v, t_ in (("ids", ids[order], pa.int64()), ("copy", copy, pa.int64()), ("low", low.ravel(), pa.float64()), ("high", high.ravel(), pa.float64()))}
        return pa.table(out | {"cells": pa.array([cell.tobytes()], pa.binary())})

    return vectors.groupBy("block", "dim").applyInArrow(made, "block int, dim int, ids array<long>, copy array<long>, low array<double>, high array<double>, cells binary")


def bounded(up: np.ndarray, down: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """up @ high.T + down @ low.T, and how far rounding may have moved it at most: 0 where all sums are whole numbers that doubles hold."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = up @ high.T + down @ low.T
        size = max(np.abs(up).max(initial=0), np.abs(down).max(initial=0)) * max(np.abs(high).max(initial=0), np.abs(low).max(initial=0))
        if 2 * size * up.shape[1] < WHOLE:
            return total, np.zeros(1)
        return total, (np.abs(up) @ np.abs(high).T + np.abs(down) @ np.abs(low).T) * (4 * up.shape[1] * 2.0**-52)


def bounds_of(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of queries and candidates whose components lie from low to high."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        (most, a), (least, b) = bounded(up, down, high, low), bounded(up, down, low, high)
        most, least = most + a, least - b
    return np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)


def bounds(index: DataFrame, n_index: int, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
    """(query_id, id, lower, upper) of each block's candidates that its cells cannot rule out."""
    schema = "query_id long, id long, lower double, upper double"

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int64, float, float)]
        if a.num_rows and b.num_rows:
            r = a.to_pylist()[0]
            ids, copy = np.array(r["ids"], np.int64), np.array(r["copy"], np.int64)
            cell = np.frombuffer(r["cells"], np.uint8).reshape(len(ids), -1)
            keep = copy <= k
            ids, cell = ids[keep], cell[keep]
            at = (np.arange(cell.shape[1]), cell)
            low, high = (np.array(r[n]).reshape(cell.shape[1], -1)[at] for n in ("low", "high"))
            qid, q = b["id"].to_numpy(), blocks.matrix(b["v"])
            for i in range(0, len(q), 256):
                lower, upper = bounds_of(q[i : i + 256], low, high)
                own = qid[i : i + 256, None] == ids
                rank = np.where(own, -np.inf, lower)
                least = np.partition(rank, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(rank), -np.inf)
                row, col = np.nonzero((upper >= least[:, None]) & ~own)
                for o, x in zip(out, (qid[i + row], ids[col], lower[row, col], upper[row, col]), strict=True):
                    o.append(x)
        return pa.table([pa.array(np.concatenate(o)) for o in out], names=["query_id", "id", "lower", "upper"])

    return blocks.met(index, n_index, queries, n_queries, search, schema)


def products(pairs: DataFrame) -> DataFrame:
    """(query_id, id, nearly, score, large_score, _digits) of pairs (query_id, id, _q, v): nearly is the score as a double, score null and
    large_score its text from LARGE on, _digits what puts such scores in order (by their text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, x = (c.flatten().to_numpy() for c in b.columns[2:])
            at = np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy())]).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                sums = np.add.reduceat(np.append(np.abs(q) * np.abs(x), 0.0), at[:-1]) if b.num_rows else np.zeros(0)
            most = np.maximum.reduceat(np.append(np.maximum(np.abs(q), np.abs(x)), 0.0), at[:-1]) if b.num_rows else np.zeros(0)
            nearly, score, text, digits = np.zeros(b.num_rows), [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            plain = (sums < LARGE / 2) & (most < LARGE)
            whole = np.where(np.repeat(plain, np.diff(at)), 1, 0)
            exact = np.add.reduceat(np.append((q * whole).astype(np.int64) * (x * whole).astype(np.int64), 0), at[:-1]) if b.num_rows else np.zeros(0, np.int64)
            for i in range(b.num_rows):
                if plain[i]:
                    nearly[i], score[i] = float(exact[i]), int(exact[i])
                    continue
                s = sum(int(c) * int(d) for c, d in zip(q[at[i] : at[i + 1]].tolist(), x[at[i] : at[i + 1]].tolist(), strict=True))
                nearly[i] = double(s)
                score[i] = s if -(1 << 63) <= s < 1 << 63 else None
                text[i] = str(s) if score[i] is None else None
                digits[i] = f"{s + 10**DIGITS:0{DIGITS + 1}d}" if abs(nearly[i]) >= LARGE else None
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearly), pa.array(score, pa.int64()), pa.array(text, pa.string()), pa.array(digits, pa.string())], names=["query_id", "id", "nearly", "score", "large_score", "_digits"])

    return pairs.select("query_id", "id", "_q", "v").mapInArrow(of, "query_id long, id long, nearly double, score long, large_score string, _digits string")


def double(x: int) -> float:
    """The nearest double, or an infinity."""
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def top_k(embeddings: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", cells: int = CELLS) -> DataFrame:
    """(query_id, rank, id, score, large_score): for each row whose id satisfies `is_query` (a condition on column id), its k best other rows."""
    # Doubles of 2**53 and more are whole already; floor() of smaller ones fits a long.
    down = lambda y: F.when(F.abs(y) < WHOLE, F.floor(F.when(F.abs(y) < WHOLE, y)).cast("double")).otherwise(y)
    whole = F.transform("v", lambda x: down(x * float(scale)))
    vectors = blocks.sound(embeddings, id_col, vector).select("id", "dim", whole.alias("v")).filter(~F.exists("v", lambda x: F.abs(x) == float("inf")))
    vectors = saved(vectors, "vectors")
    dealt, n = blocks.dealt(vectors, blocks.CANDIDATES, "block")
    asked, m = blocks.dealt(vectors.filter(is_query), blocks.QUERIES, "qblock")
    found = saved(bounds(saved(build(dealt, cells), "vafile"), n, asked, m, k), "bounds")

    def best(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
        """The first k of each query: reduced to k of a task before the shuffle."""
        return df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col(name) <= k)

    kth = best(found, "_r", F.desc("lower"), "id").groupBy("query_id").agg(F.count("*").alias("_n"), F.min("lower").alias("_least"))
    left = saved(found.join(kth, "query_id").filter((F.col("_n") < k) | (F.col("upper") >= F.col("_least"))).select("query_id", "id", "upper"), "left")

    exact = vectors.select("id", "v")
    asked_v = vectors.filter(is_query).select(F.col("id").alias("query_id"), F.col("v").alias("_q"))

    def read(pairs: DataFrame) -> DataFrame:
        return products(pairs.join(exact.hint("merge"), "id").join(asked_v.hint("merge"), "query_id"))

    promising = saved(best(left, "_r", F.desc("upper"), "id").select("query_id", "id"), "promising")
    first = saved(read(promising), "first")
    # A score of which only the double is known may lie a little below it.
    low = F.when(F.col("_digits").isNull(), F.col("nearly")).otherwise(F.col("nearly") - F.abs("nearly") * 2.0**-50)
    enough = first.groupBy("query_id").agg(F.min(low).alias("_enough"))
    second = read(left.join(promising, ["query_id", "id"], "left_anti").join(enough, "query_id").filter(F.isnan("_enough") | (F.col("upper") >= F.col("_enough"))).select("query_id", "id"))
    ranked = best(first.unionByName(second), "rank", F.desc("nearly"), F.desc("_digits"), F.desc("score"), "id")
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score", "large_score")
