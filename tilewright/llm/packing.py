"""Sum-of-squares packing of token sequences.

Pieces are dealt at random into shards of bounded size; a shard's pieces are placed one by one where the
squared counts of open bins per residual gap become smallest. Bins that a shard leaves open are opened up
again and packed once more with those of other shards, so that waste does not grow with the shards.
Full-length pieces are sequences of their own and never reach a task.

Nulls: a null text is empty, so its document is the one separator; null ids are kept as they are. Repeated
rows are packed each for itself. An empty table gives no rows. Input columns other than the id and the text
do not take part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import bpe
from tilewright.llm.common import free_name, lean, numbered, saved

#: Pieces of a shard, on average: what one task packs at once.
SHARD = 8192


def squares_pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the given order. Lengths are from 1 to capacity.

    An item of size s may go into a bin of gap g >= s or a new one (gap = capacity). Taking it changes the sum of squared
    counts of gaps by 2 (count[g - s] - count[g]) + 2, and by 2 count[capacity - s] + 1 for a new bin; bins that become full
    do not count. Ties go to the smaller gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    far = np.int64(1) << 60
    for i, s in enumerate(lengths.tolist()):
        cost = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        cost[0] = 1 - 2 * count[s]
        cost[count[s:] == 0] = far
        cost[capacity - s] = 2 * count[capacity - s] + 1 if s < capacity else 0
        g = s + int(np.argmin(cost))
        if g < capacity:
            b = bins[g].pop()
            count[g] -= 1
        else:
            b = len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += s
        if g > s:
            bins[g - s].append(b)
            count[g - s] += 1
    return where, offset


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every text's ids followed by the separator.

    Only longer ones are cut, from the end: every piece but the first has full length.
    """
    schema = T.StructType([docs.schema[id_col], *[T.StructField(n, t()) for n, t in (("piece", T.IntegerType), ("start", T.LongType), ("length", T.LongType), ("ids_crc32", T.LongType))]])
    schema = schema.add("ids", T.ArrayType(T.IntegerType())) if keep_ids else schema
    last = np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = bpe.encoder(tokenizer_path)
        for b in batches:
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                data = run(t or "") + last
                n = len(data) // 4
                ends = range(n % capacity or capacity, n + 1, capacity) if n > capacity else (n,)
                start = 0
                for k, end in enumerate(ends):
                    part = data[4 * start : 4 * end]
                    rows.append((i, k, start, end - start, zlib.crc32(part), part if keep_ids else None))
                    start = end
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            made = [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *[pa.array(cols[j], pa.int64()) for j in (2, 3, 4)]]
            if keep_ids:
                made.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(lean(cut), schema)


def shard_pack(rows: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """rows of (_row, length), with (_shard, _bin, _at, _filled: what the bin holds in the end). Longer pieces first."""
    schema = "_row long, length long, _level int, _shard int, _bin int, _at long, _filled long"

    def packed(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "_row"], ascending=[False, True], ignore_index=True)
        where, at = squares_pack(p["length"].to_numpy(), capacity)
        filled = np.bincount(where, p["length"].to_numpy(), where.max() + 1).astype(np.int64)
        return pd.DataFrame({"_row": p["_row"], "length": p["length"], "_level": level, "_shard": key[0], "_bin": where, "_at": at, "_filled": filled[where]})

    dealt = rows.select("_row", "length", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(shards)).cast("int").alias("_shard"))
    return dealt.groupBy("_shard").applyInPandas(packed, schema)


def pack(table: DataFrame, *, capacity: int = 2048, length: str = "length", shard: int = SHARD) -> DataFrame:
    """table (any columns, lengths from 1 to capacity) with `sequence_id` and `offset`.

    The table is written once, with its rows' numbers. Rows with a null length, or one that is not from
    1 to capacity, get null for both. Columns named sequence_id or offset are replaced; all others stay, whatever their names.
    """
    kept = [c for c in table.columns if c.lower() not in ("sequence_id", "offset")]
    row = free_name("_row", kept)
    own = numbered(table.select(*[F.col(f"`{c}`") for c in kept]), row, "pieces")
    size = F.col(f"`{length}`")
    short = own.filter(size.between(1, capacity - 1)).select(F.col(row).alias("_row"), size.cast("long").alias("length"))
    n = short.count()
    first = saved(shard_pack(short, max(1, -(-n // shard)), 1, capacity), "packed")
    # What a shard could not fill is packed again: bins with a gap that a typical piece would still fit.
    loose = F.col("_filled") < int(capacity * 0.97)
    again = first.filter(loose).select("_row", "length")
    m = again.count()
    placed = first.filter(~loose)
    if m:
        placed = placed.unionByName(shard_pack(again, max(1, -(-m // shard)), 2, capacity))
    ids = placed.select(F.col("_row").alias(row), ((F.col("_level").cast("long") * (1 << 28) + F.col("_shard")) * (1 << 31) + F.col("_bin")).alias("sequence_id"), F.col("_at").alias("offset"))
    whole = size == capacity
    return (
        own.join(ids.hint("merge"), row, "left")
        .withColumn("sequence_id", F.when(whole, -1 - F.col(row)).otherwise(F.col("sequence_id")))
        .withColumn("offset", F.when(whole, F.lit(0).cast("long")).otherwise(F.col("offset")))
        .drop(row)
    )
