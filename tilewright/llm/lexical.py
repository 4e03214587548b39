"""Ranked lexical search: hashed max-sketches of documents give upper bounds, and documents are scored exactly in the order of their bounds until none can enter the best.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z alone in lower case. `index` makes, in one pass over the texts, a row for each document: its number of terms, and a
sketch. A sketch has two lines of cells, as many as fit the document's distinct terms; each term falls into a cell of each line, and a cell keeps the largest count of its terms. As a term's
impact grows with its count, the lesser of its two cells bounds its impact from above. It also counts how many documents hold each term (a table, like all the rest).

`search` looks the terms of the items up in that table and deals the items out in blocks of a bounded number of terms, which are sent to all tasks. For a batch of documents the
sketches' cells are read for all terms of a block at once, and sums of weights times impacts bound every score. The documents that lie highest for some item are scored by
their texts, which raises what an item's next best has to reach in this task, and so on down, until no bound reaches it (equal ones do: ids decide). Each task returns its best
for each item, and the best of those are the answer.

Documents without a term of an item are in no ranking. Null texts have no terms; repeated rows are ranked one by one, ties by id (nulls last). Items are rows of their own, with null or repeated ids too. An item's
repeated terms count as often as they stand. Texts are taken whole. Empty tables give no rows. Other columns do not take part. Terms are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tilewright.llm import bytesvec as V
from tilewright.llm.common import lean, numbered, saved

TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Cells of a line for each distinct term, and the fewest (as powers of two).
ROOM, LEAST_BITS, LINES = 3, 6, 2
#: Counts of this many or more are taken as unbounded.
MANY = 255
ONE = 1_000_000_000
#: Terms of a block of items, and items whose bounds are summed at once; documents whose sketches are read at once.
BLOCK_TERMS, GROUP, BATCH = 1 << 17, 32, 512


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, row) of the terms of a run of texts, in order; place: (start, end)."""
    data = LOWER[data]
    start, end, row = V.spans(TERM[data], at)
    return V.word_hashes(data, start, end, 41), np.column_stack([start, end]), row


def second(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    return V.word_hashes(LOWER[data], place[:, 0].copy(), place[:, 1].copy(), 42)


def counted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count, place of one) of the distinct terms of each row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    return row[cut], h[cut], np.diff(np.append(cut, len(h))), order[cut]


def cells(h: np.ndarray, bits: int | np.ndarray) -> list[np.ndarray]:
    """A term's cell in each line of 2**bits."""
    shift = np.uint64(64) - np.asarray(bits, np.uint64)
    return [(h >> shift).astype(np.int64), ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)]


def bits_of(n: np.ndarray) -> np.ndarray:
    """Bits of a line's cells for so many distinct terms."""
    return np.maximum(LEAST_BITS, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + ROOM)


def index(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, terms). documents: id, text, n, bits, sketch, of those with a term; terms: h1, h2, df."""
    own_id = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", own_id), T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("bits", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("df", T.LongType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, at in V.runs(b.column(1)):
                m = len(at) - 1
                h, place, row = terms(data, at)
                n = np.bincount(row, minlength=m)
                of, h1, count, one = counted(h, row)
                bits = bits_of(np.bincount(of, minlength=m))
                size = np.where(n > 0, LINES << bits, 0)
                base = np.concatenate([[0], np.cumsum(size)])
                sketch = np.zeros(base[-1], np.uint8)
                # The largest count comes last, and so stays.
                order = np.argsort(count, kind="stable")
                for line, cell in enumerate(cells(h1, bits[of])):
                    sketch[(base[of] + line * (1 << bits[of]) + cell)[order]] = np.minimum(count[order], MANY)
                has = np.flatnonzero(n > 0)
                rows = b.slice(i, m).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n[has]), pa.array(bits[has].astype(np.int32)), pa.array([sketch[base[k] : base[k + 1]].tobytes() for k in has], pa.binary()), *[pa.nulls(len(has), pa.int64())] * 3], names=schema.names)
                # The run's terms, with the documents that hold them.
                own, first, df = np.unique(h1, return_index=True, return_counts=True)
                k = len(own)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, b.column(0).type), pa.nulls(k, b.column(1).type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(own.view(np.int64)), pa.array(second(data, place[one[first]]).view(np.int64)), pa.array(df)], names=schema.names)

    both = saved(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(lean(made), schema), "sketches")
    return both.filter("n IS NOT NULL").select("id", "text", "n", "bits", "sketch"), both.filter("df IS NOT NULL").groupBy("h1", "h2").agg(F.sum("df").alias("df"))


def item_terms(items: DataFrame, text: str) -> DataFrame:
    """(_item, h1, h2, times) of items (_item, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, at in V.runs(b.column(1)):
                h, place, row = terms(data, at)
                of, h1, count, one = counted(h, row)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(at) - 1).take(pa.array(of)), pa.array(h1.view(np.int64)), pa.array(second(data, place[one]).view(np.int64)), pa.array(count.astype(np.int64))], names=["_item", "h1", "h2", "times"])

    return items.select("_item", F.col(text)).mapInArrow(lean(made), "_item long, h1 long, h2 long, times long")


class Block:
    """The terms of a block of items: distinct ones by hash, and for each item which ones it has, with their weights."""

    def __init__(self, rows: list[tuple[int, int, int, int]]) -> None:
        item, h1, h2, weight = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        self.items, of = np.unique(item, return_inverse=True)
        both, at = np.unique(np.column_stack([h1, h2]).view(np.uint64), axis=0, return_inverse=True)
        self.h1, self.h2 = both[:, 0], both[:, 1]
        at = at.ravel()
        order = np.lexsort((of, at))
        #: By term: the items that have it, with the weight times its repeats in them.
        self.owner, self.weight, self.first = of[order], weight[order], np.searchsorted(at[order], np.arange(len(both) + 1))
        self.groups = []
        for low in range(0, len(self.items), GROUP):
            mine = np.flatnonzero((of >= low) & (of < low + GROUP))
            own, where = np.unique(at[mine], return_inverse=True)
            table = np.zeros((len(own), min(GROUP, len(self.items) - low)))
            table[where, of[mine] - low] = weight[mine]
            self.groups.append((low, own, table))

    def bounds(self, sketches: np.ndarray, bits: int, low: np.ndarray) -> np.ndarray:
        """(documents x items): what no score exceeds. sketches: a row for each document; low: its m."""
        # Cells beyond the counts that a byte holds bound nothing: their impact is the most there is.
        counts = np.arange(MANY + 1)
        steps = ONE * counts // np.maximum(1, 1000 * counts + 8 * low[:, None])
        steps[:, MANY] = ONE // 1000
        one, two = cells(self.h1, bits)
        out = np.zeros((len(sketches), len(self.items)))
        for first, own, table in self.groups:
            held = np.minimum(sketches[:, one[own]], sketches[:, (1 << bits) + two[own]])
            out[:, first : first + table.shape[1]] = np.take_along_axis(steps, held.astype(np.int64), axis=1).astype(np.float64) @ table
        return out * (1 + 1e-9)

    def scores(self, text: str, low: int) -> np.ndarray:
        """A document's exact score for each item."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        h, place, row = terms(data, np.array([0, len(data)]))
        _, h, count, one = counted(h, row)
        at = np.searchsorted(self.h1, h)
        at[at == len(self.h1)] = 0
        known = np.flatnonzero(self.h1[at] == h)
        known = known[self.h2[at[known]] == second(data, place[one[known]])]
        at, count = at[known], count[known]
        impact = ONE * count // (1000 * count + 8 * low)
        n = self.first[at + 1] - self.first[at]
        where = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out = np.zeros(len(self.items), np.int64)
        np.add.at(out, self.owner[where], self.weight[where] * np.repeat(impact, n))
        return out


def best_in_task(block: Block, n_docs: int, n_terms: int, k: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over a task's batches (id, text, n, bits, sketch) that returns its best documents for each item of a block."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        #: For each item its best (score, id as ranked, serial number), and the score that one more has to reach.
        best: list[list[tuple]] = [[] for _ in block.items]
        least = np.ones(len(block.items))

        def scored(ids: list, texts: list, lows: np.ndarray, numbers: range) -> None:
            for doc, text, low, number in zip(ids, texts, lows.tolist(), numbers, strict=True):
                score = block.scores(text, low)
                for i in np.flatnonzero(score >= least).tolist():
                    best[i].append((-int(score[i]), doc is None, doc if doc is not None else 0, number, doc))
                    best[i].sort(key=lambda x: x[:4])
                    del best[i][k:]
                    if len(best[i]) == k:
                        least[i] = -best[i][-1][0]

        for b in batches:
            lows_all = 25 + 75 * b.column(2).to_numpy() * n_docs // n_terms
            bits_all = b.column(3).to_numpy()
            for bits in np.unique(bits_all).tolist():
                same = np.flatnonzero(bits_all == bits)
                step = max(1, BATCH << 12 >> max(12, bits))
                for j in range(0, len(same), step):
                    take = same[j : j + step]
                    rows = b.take(pa.array(take))
                    sketches = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(len(take), -1)
                    lows = lows_all[take]
                    bound = block.bounds(sketches, bits, lows)
                    ids, left = rows.column(0), np.ones(len(take), bool)
                    while True:
                        # What may still enter some item's best: the k that lie highest for each item come first.
                        able = np.flatnonzero(left & (bound >= least).any(axis=1))
                        if not len(able):
                            break
                        open_items = np.flatnonzero((bound[able] >= least).any(axis=0))
                        over = np.where(bound[np.ix_(able, open_items)] >= least[open_items], bound[np.ix_(able, open_items)], -1.0)
                        top = np.unique(np.argpartition(-over, min(k, len(able)) - 1, axis=0)[:k]) if len(able) > k else np.arange(len(able))
                        pick = able[top[(over[top] >= 0).any(axis=1)]]
                        texts = rows.column(1).take(pa.array(pick)).to_pylist()
                        scored(ids.take(pa.array(pick)).to_pylist(), texts, lows[pick], range(serial, serial + len(pick)))
                        serial += len(pick)
                        left[pick] = False
        rows = [(int(item), -x[0], x[4], (part << 32) + x[3]) for item, own in zip(block.items, best, strict=True) for x in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), kind, pa.int64()), strict=True)], names=["_item", "score", "id", "_serial"])

    return found


def blocks(weighted: DataFrame, most: int) -> Iterator[Block]:
    """The items' terms, in blocks of up to `most` terms (an item with more is one of its own): a block at a time is on the driver."""
    rows, n, item = [], 0, None
    for r in weighted.orderBy("_item").toLocalIterator():
        if r["_item"] != item and n >= most:
            yield Block(rows)
            rows, n = [], 0
        item = r["_item"]
        rows.append((item, r["h1"], r["h2"], r["weight"]))
        n += 1
    if rows:
        yield Block(rows)


def search(indexed: tuple[DataFrame, DataFrame], items: DataFrame, *, item_col: str = "item_id", text: str = "text", k: int = 10, most: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): for each item the k documents of `index` with the highest scores above 0."""
    docs, dictionary = indexed
    spark = docs.sparkSession
    n_docs, n_terms = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = numbered(items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text}`").alias("text")), "_item", "items")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    known = saved(item_terms(own, "text").join(dictionary.hint("merge"), ["h1", "h2"]).select("_item", "h1", "h2", (F.col("times") * weight).alias("weight")), "weights")
    schema = T.StructType([T.StructField("_item", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("_serial", T.LongType())])
    out = spark.createDataFrame([], schema)
    for block in blocks(known, most):
        found = best_in_task(block, n_docs, n_terms, k, to_arrow_type(docs.schema["id"].dataType))
        out = out.unionByName(saved(docs.mapInArrow(lean(found), schema), "best"))
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "_serial")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(own.select("_item", "item").hint("merge"), "_item").select(F.col("item").alias(item_col), "rank", "id", "score")
