"""Quality by ordinal regression with cumulative links.

P(grade <= k) = sigmoid(threshold[k] - weights . x): one set of weights over hashed words, word shapes and repeats, and thresholds in
order. A text's features are the square roots of their shares of its words. Gives the expected grade, and the probability
of a grade of at least `least`, by which texts are selected.

Fitted on a sample of at most `most` graded rows; everything else covers all rows and whole texts, of any length. Null and empty texts
have no features, and are judged by the thresholds alone; null ids are kept; repeated rows are scored each for itself;
without graded rows all are kept. An empty table gives no rows.
Columns with the names of outputs are replaced; others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm import bytesvec as V
from tilewright.llm.common import lean
from tilewright.llm.labelled import gathered, sample, shape_features, sigmoid

BITS, SAMPLE = 14, 4000


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, of values weights . x."""
        return sigmoid(x[:, None] - self.thresholds)


def fit_ordinal(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, ridge: float = 2e-4, rounds: int = 250, rate: float = 0.3) -> Ordinal:
    """By Adam steps on the mean log likelihood. y: grades 0..K-1. Thresholds are kept in order: a first one and steps that are powers of e."""
    n, k = len(y), int(y.max(initial=0)) + 1
    shares = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / max(1, n), 1e-3, 1 - 1e-3)
    start = np.log(shares / (1 - shares))
    p = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        cut = np.cumsum(np.concatenate([p[size : size + 1], np.exp(p[size + 1 :])]))
        x = np.bincount(row, p[bucket] * value, n)
        edge = np.concatenate([np.zeros((n, 1)), sigmoid(cut - x[:, None]), np.ones((n, 1))], axis=1)
        slope = edge * (1 - edge)
        i = np.arange(n)
        mass = np.maximum(edge[i, y + 1] - edge[i, y], 1e-12)
        up, down = slope[i, y + 1] / mass, slope[i, y] / mass
        g = np.zeros_like(p)
        g[:size] = np.bincount(bucket, value * (up - down)[row], size) / n + ridge * p[:size]
        of_cut = np.zeros(k + 1)
        np.add.at(of_cut, y + 1, -up)
        np.add.at(of_cut, y, down)
        later = np.cumsum(of_cut[1:k][::-1])[::-1] / n
        g[size] = later[0]
        g[size + 1 :] = later[1:] * np.exp(p[size + 1 :])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * 0.98 ** (t / 4) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Ordinal(p[:size], np.cumsum(np.concatenate([p[size : size + 1], np.exp(p[size + 1 :])])))


def counted(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the rows' features, without repeats."""
    row, bucket, n = shape_features(data, at, BITS)
    pair, first, count = np.unique((row << BITS) + bucket, return_index=True, return_counts=True)
    return pair >> BITS, pair & ((1 << BITS) - 1), np.sqrt(count / n[first]) if len(pair) else np.zeros(0)


def fit(docs: DataFrame, graded: DataFrame, *, grade: str = "grade", most: int = SAMPLE, id_col: str = "doc_id", text: str = "text") -> Ordinal:
    """graded: (id, grade), whole grades from 0."""

    def features(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        return list(counted(data, at)[1:])

    got, y = gathered(sample(docs, graded, [grade], most, id_col=id_col, text=text), features, [grade])
    if len({*y[:, 0]}) < 2:
        return Ordinal(np.zeros(1 << BITS), np.array([-35.0]))
    bucket = [np.frombuffer(f[0], np.int32) for f in got]
    row = np.repeat(np.arange(len(bucket)), [len(x) for x in bucket])
    return fit_ordinal(row, np.concatenate(bucket).astype(np.int64), np.concatenate([np.frombuffer(f[1], np.float32) for f in got]).astype(float), y[:, 0].astype(int), 1 << BITS)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of quality and toxicity labels: 0 of low quality, 1 of high quality but toxic, 2 of high quality and clean."""
    grade: Column = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    return labels.select("doc_id", grade.alias("grade"))


def score(docs: DataFrame, model: Ordinal, *, least: int = 1, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probability (of a grade of at least `least`) and `keep`. Columns of these names are replaced."""
    added = ["expected_grade", "tail_probability", "keep"]
    kept = [f for f in docs.schema.fields if f.name not in added]
    at_least = min(least, len(model.thresholds)) - 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros(b.num_rows)
            for i, data, at in V.runs(b.column(b.num_columns - 1)):
                row, bucket, value = counted(data, at)
                x[i : i + len(at) - 1] = np.bincount(row, model.weights[bucket] * value, len(at) - 1)
            tails = model.tails(x)
            cols = [pa.array(tails.sum(axis=1)), pa.array(tails[:, at_least]), pa.array(tails[:, at_least] >= threshold)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*(f.name for f in kept), *added])

    ins = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("_in"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "expected_grade double, tail_probability double, keep boolean"])
    return ins.mapInArrow(lean(scored), schema)
