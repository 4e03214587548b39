"""Vectors in blocks: a query set against all rows without a join of rows.

Candidates are dealt at random into blocks of bounded size, queries too; every block of queries meets every block of
candidates in a task of its own. Nothing is broadcast, and no group can grow with the data: a key that a third of the rows
share is spread over all blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import first_copy

CANDIDATES, QUERIES = 4096, 2048


def sound(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v: array<double>, dim) of rows with an id and a vector that is neither null nor holds null, NaN or infinite
    components. Rows that share an id count once, with the smallest vector."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    return first_copy(rows.filter(~F.coalesce(bad, F.lit(True))), "id", "v").withColumn("dim", F.size("v"))


def dealt(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """df with a block number by a hash of the id, and how many blocks there are."""
    n = max(1, -(-df.count() // size))
    return df.withColumn(name, F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n)).cast("int")), n


def matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return x.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(x), -1)


def met(index: DataFrame, n_index: int, queries: DataFrame, n_queries: int, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """index: one row for each (block, dim); queries: (id, v, dim, qblock). search gets both of a pair of blocks of one dimension."""
    left = index.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))))
    keys = ("block", "qblock", "dim")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)
