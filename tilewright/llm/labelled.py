"""Hashed features of texts, and samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm import bytesvec as V
from tilewright.llm.common import lean

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A byte's kind: capital, other letter, digit; any other byte is a kind of its own.
KIND = np.arange(256, dtype=np.uint8)
KIND[65:91], KIND[97:123], KIND[128:256], KIND[48:58] = 65, 97, 97, 48
PREFIXES = (4, 5, 6, 7)


@cache
def hasher(seed: int) -> V.Hasher:
    return V.Hasher(seed)


def letter_features(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the words of letters, ASCII in lower case, and of their first bytes. With repeats."""
    data = LOWER[data]
    start, end, row = V.spans(LETTER[data], at)
    ends = [np.minimum(end, start + n) for n in PREFIXES] + [end]
    found = [hasher(21).of(data, start, e) >> np.uint64(64 - bits) for e in ends]
    return np.tile(row, len(found)), np.concatenate(found).astype(np.int64)


def shape_features(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, words of the row) of the words, of their shapes (kinds of bytes, repeats collapsed), and of words that repeat the one before."""
    start, end, row = V.words(data, at)
    if not len(start):
        return start, start, start
    kind = KIND[data]
    first = np.zeros(len(data), bool)
    first[start] = True
    new = first | (kind != np.concatenate([[0], kind[:-1]]))
    place = np.concatenate([[0], np.cumsum(new)])
    word = hasher(22).of(data, start, end)
    # A word's kinds: those from the one that starts it to the last that begins in it.
    shape = hasher(23).of(kind[new], place[start], place[end])
    again = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) + 1
    n = np.bincount(row, minlength=len(at) - 1)
    shift = np.uint64(64 - bits)
    rows = np.concatenate([row, row, row[again]])
    return rows, np.concatenate([(word >> shift), (shape >> shift), np.zeros(len(again), np.uint64)]).astype(np.int64), n[rows]


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_text, columns...) of at most `most` labelled rows, taken by a hash of their id. An id's labels count once (the smallest); rows with a null text,
    id or label are left out."""
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), *columns).dropna().groupBy("_id").agg(F.min(F.struct(*columns)).alias("_l"))
    # The sample has a fixed bound, and so may be sent to all.
    taken = known.orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id", "_l.*")
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text")).filter("_id is not null and _text is not null")
    pairs = own.join(F.broadcast(taken), "_id")
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("_id").orderBy("_text"))).filter("_r = 1").select("_text", *columns)


def gathered(rows: DataFrame, features: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], columns: list[str]) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """(features of each row, its labels) of a bounded sample, in an order that does not depend on the run. features gives, of a text: arrays."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0):
                data = np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                out.append([x.astype(np.float32 if x.dtype.kind == "f" else np.int32).tobytes() for x in features(data, np.array([0, len(data)]))])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary())), *b.columns[1:]], names=["f", *columns])

    schema = "f array<binary>, " + ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    got = sorted(((tuple(bytes(x) for x in r["f"]), tuple(r[c] for c in columns)) for r in rows.mapInArrow(lean(made), schema).toLocalIterator()))
    return [list(f) for f, _ in got], np.array([y for _, y in got]).reshape(-1, len(columns))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
