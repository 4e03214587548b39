"""Toxicity by a classifier chain.

Categories are predicted one after another: a category's model is linear in the presence of hashed words and word
beginnings and in the probabilities of the categories before it. The chain is trained with out-of-fold predictions: what a later
model sees of an earlier one in training is what a chain says that was fitted without the row. The last category is the label itself. The tables
have no other labels, so those before it are learned: groups of toxic labelled rows by the words that they use.

Fitted on a sample of at most `most` labelled rows; everything else covers all rows and whole texts, of any length. Null and empty texts
have the probability of a text without features, and are not toxic by it; null ids are kept; repeated rows are scored each
for itself; without labels, or with labels of one kind only, nothing is toxic. An empty table gives no rows. Columns with the names of outputs are replaced; others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import bytesvec as V
from tilewright.llm.common import lean
from tilewright.llm.labelled import gathered, letter_features, sample, sigmoid

#: Categories before the last: groups of toxic rows that use the same words.
GROUPS = ("group_1", "group_2")
BITS, SAMPLE, FEATURES, FOLDS = 20, 5000, 150, 5
#: Half the likelihood ratio that a bucket must reach to be used, and the weight of the ridge penalty.
LEAST_GAIN, RIDGE = 6.0, 0.05


@dataclass
class Link:
    """One model of the chain: weights of buckets, of earlier probabilities, and a constant."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float = -10.0


def telling(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The buckets that speak most for y: by the likelihood ratio of their presence among rows with and without it."""
    with_y = np.bincount(bucket, y[row].astype(float), 1 << BITS)
    seen = np.flatnonzero(with_y >= 2)
    with_y = with_y[seen]
    a, b = with_y + 0.5, np.bincount(bucket, minlength=1 << BITS)[seen] - with_y + 0.5
    p, n = y.sum() + 1, len(y) - y.sum() + 1
    total = (a + b) / (p + n)
    gain = a * np.log(a / p / total) + b * np.log(b / n / total) + (p - a) * np.log(np.maximum(1 - a / p, 1e-9) / np.maximum(1 - total, 1e-9)) + (n - b) * np.log(np.maximum(1 - b / n, 1e-9) / np.maximum(1 - total, 1e-9))
    gain[a / p < 2 * b / n] = 0  # what toxic rows hold more often
    order = np.lexsort((seen, -gain))[:most]
    return np.sort(seen[order[gain[order] > LEAST_GAIN]])


def dense(row: np.ndarray, bucket: np.ndarray, n: int, buckets: np.ndarray) -> np.ndarray:
    x = np.zeros((n, len(buckets)))
    if len(buckets):
        at = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
        hit = buckets[at] == bucket
        x[row[hit], at[hit]] = 1
    return x


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge penalty, by accelerated gradient steps."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = last = np.zeros(z.shape[1])
    step = 4 / max(1e-9, float(np.linalg.eigvalsh(z.T @ z)[-1]) / len(z) + 4 * ridge / len(z))
    penalty = np.full(len(w), ridge / len(z))
    penalty[-1] = 0
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - last)
        last, w = w, ahead - step * (z.T @ (sigmoid(z @ ahead) - y) / len(z) + penalty * ahead)
    return w[:-1], float(w[-1])


def fit_link(row: np.ndarray, bucket: np.ndarray, earlier: np.ndarray, y: np.ndarray, features: int) -> Link:
    n = len(y)
    if not 2 <= y.sum() <= n - 2:
        return Link(earlier=np.zeros(earlier.shape[1]))
    buckets = telling(row, bucket, y, features)
    w, c = fit_linear(np.concatenate([dense(row, bucket, n, buckets), earlier], axis=1), y.astype(float))
    return Link(buckets, w[: len(buckets)], w[len(buckets) :], c)


def apply_link(link: Link, row: np.ndarray, bucket: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """row and bucket without repeats."""
    total = np.full(len(earlier), link.constant)
    if len(link.buckets):
        at = np.minimum(np.searchsorted(link.buckets, bucket), len(link.buckets) - 1)
        hit = link.buckets[at] == bucket
        total += np.bincount(row[hit], link.weights[at[hit]], len(earlier))
    return sigmoid(total + earlier @ link.earlier)


def apply_chain(chain: list[Link], row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """The categories' probabilities of n rows, one after another. row and bucket without repeats."""
    p = np.zeros((n, 0))
    for link in chain:
        p = np.column_stack([p, apply_link(link, row, bucket, p)])
    return p


def fit_chain(row: np.ndarray, bucket: np.ndarray, targets: list[np.ndarray], features: int = FEATURES, folds: int = FOLDS, inner: int = 3) -> list[Link]:
    """A link for each target, in order. row, bucket: the distinct features of each row.

    What a link sees of earlier categories is what a chain says that was fitted without the row: one for each fold, which picks its buckets, and gets its
    own out-of-fold values, from the other folds' rows alone (`inner` folds of them; in those, the links before see no earlier categories).
    """
    n = len(targets[0]) if targets else 0
    fold = np.arange(n) % max(1, folds)
    seen = np.zeros((n, len(targets)))
    for k in range(folds if n > folds and len(targets) > 1 else 0):
        use, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        place = np.zeros(n, np.int64)
        place[use], place[held] = np.arange(len(use)), np.arange(len(held))
        within = fold[row] != k
        r, b = place[row[within]], bucket[within]
        others = [y[use] for y in targets]
        chain = fit_chain(r, b, others, features, inner, 0) if inner else [fit_link(r, b, np.zeros((len(use), 0)), y, features) for y in others]
        r, b = place[row[~within]], bucket[~within]
        seen[held] = apply_chain(chain, r, b, len(held)) if inner else np.column_stack([apply_link(c, r, b, np.zeros((len(held), 0))) for c in chain])
    return [fit_link(row, bucket, seen[:, :j], y, features) for j, y in enumerate(targets)]


def groups_of(row: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, k: int = len(GROUPS), rounds: int = 12, seed: int = 3) -> np.ndarray:
    """The group of each toxic row, by which words it uses (-1 for other rows): k means of the directions of their telling buckets, from the two rows that lie farthest apart."""
    out = np.full(len(toxic), -1)
    buckets = telling(row, bucket, toxic, FEATURES) if toxic.sum() >= 2 else np.zeros(0, np.int64)
    if not len(buckets):
        return out
    x = dense(row, bucket, len(toxic), buckets)[toxic]
    x = x - x.mean(axis=0)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    means = x[np.random.default_rng(seed).integers(0, len(x), 1)]
    for _ in range(k - 1):
        means = np.vstack([means, x[np.argmin((x @ means.T).max(axis=1))]])
    for _ in range(rounds):
        of = np.argmax(x @ means.T, axis=1)
        means = np.vstack([x[of == j].mean(axis=0) if (of == j).any() else means[j] for j in range(k)])
    out[toxic] = of
    return out


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", most: int = SAMPLE, id_col: str = "doc_id", text: str = "text") -> list[Link]:
    """The chain for the groups of toxic rows and then the label (0 or 1)."""

    def features(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        return [np.unique(letter_features(data, at, BITS)[1])]

    got, y = gathered(sample(docs, labels, [label], most, id_col=id_col, text=text), features, [label])
    found = [np.frombuffer(f[0], np.int32) for f in got]
    row, bucket = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int64)
    toxic = y[:, 0].astype(int) == 1 if len(y) else np.zeros(0, bool)
    of = groups_of(row, bucket, toxic)
    return fit_chain(row, bucket, [*(of == j for j in range(len(GROUPS))), toxic])


def score(docs: DataFrame, chain: list[Link], *, names: list[str] | None = None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs with p_<category> of each category of the chain, `toxicity` (that of the last) and `is_toxic`. Columns of these names are replaced."""
    names = [f"p_{c}" for c in names or GROUPS]
    added = [*names, "toxicity", "is_toxic"]
    kept = [f for f in docs.schema.fields if f.name not in added]
    watched = np.unique(np.concatenate([c.buckets for c in chain])) if chain else np.zeros(0, np.int64)
    slot = np.zeros(1 << BITS, bool)
    slot[watched] = True

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros((b.num_rows, 0))]
            pairs = [np.zeros(0, np.int64)]
            for i, data, at in V.runs(b.column(b.num_columns - 1)):
                row, bucket = letter_features(data, at, BITS)
                hit = slot[bucket]
                pairs.append(((row[hit] + i) << BITS) + bucket[hit])
            pair = np.unique(np.concatenate(pairs))
            row, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
            p = found[0]
            for link in chain:
                p = np.column_stack([p, apply_link(link, row, bucket, p)])
            cols = [pa.array(x) for x in p.T] + [pa.array(p[:, -1]), pa.array(p[:, -1] >= threshold)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols[: len(names)], *cols[-2:]], names=[*(f.name for f in kept), *added])

    ins = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("_in"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} double" for n in added[:-1]), "is_toxic boolean"])
    return ins.mapInArrow(lean(scored), schema)
