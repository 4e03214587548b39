"""Shared folder and written tables.

Lineage is cut with tables written below the folder that the cluster names in
``spark.checkpoint.dir``: every executor can read them again after another one is lost.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set a local one is made and set, but only for a local master (tests): executors
    elsewhere would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written as a table in the shared folder."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, row: str, name: str) -> DataFrame:
    """df with a number for each row, written with it: read again, in other splits too, a row keeps its number."""
    return saved(df.withColumn(row, F.monotonically_increasing_id()), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(f: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """f, a function over a task's batches, which gives freed memory back at the task's end: workers live on between tasks."""

    @functools.wraps(f)
    def run(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def free_name(name: str, columns: list[str]) -> str:
    """A name that no column has, in any case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def first_copy(df: DataFrame, key: str, *values: str) -> DataFrame:
    """One row per non-null key: repeated keys keep the smallest values. Reduced before the shuffle."""
    kept = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*values)).alias("_least"))
    return kept.select(key, *[F.col(f"_least.{v}").alias(v) for v in values])
