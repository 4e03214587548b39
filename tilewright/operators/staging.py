"""Tables written between steps of a job, joins on keys that many rows share, and ranks and running sums by ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one key that a task may be left with, and the most keys that can have more than their share: a thousand.
LEAST_HOT, SHARE = 1_000_000, 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local master without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(rows: DataFrame, keys: list[str], least: int = LEAST_HOT) -> DataFrame | None:
    """(keys, _parts) of keys with over `least` rows and over a thousandth of all, a thousand at most; None if there is none. _parts: how many shares to cut their rows into."""
    total = rows.count()
    if total <= least:
        return None
    limit = max(least, total // SHARE)
    n = F.ceil(F.count("*") / limit).cast("int").alias("_parts")
    found = rows.groupBy(*keys).agg(n).filter("_parts > 1").collect()
    return rows.sparkSession.createDataFrame(found, rows.groupBy(*keys).agg(n).schema) if found else None


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], least: int = LEAST_HOT) -> DataFrame:
    """The join of both by keys. A key that many rows of the first side share is cut into parts, each of which meets the second side's rows of that key in a task of its own."""
    hot = hot_keys(many, keys, least)
    if hot is None:
        return many.join(few, keys)
    hot, n = F.broadcast(hot), F.coalesce("_parts", F.lit(1))
    left = many.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), n).cast("int")).drop("_parts")
    right = few.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"]).drop("_part")


def classed(rows: DataFrame, name: str, by: list[str], least: int = LEAST_HOT) -> DataFrame:
    """rows with `class_id`: the least `name` of the rows that are equal in `by`. Null and NaN are equal, and each other's like. What holds for one row of a class holds for all, so that joins need
    only meet classes, however many copies there are."""
    rows = written(rows.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in by}), "rows")
    return spread_join(rows, rows.groupBy(*by).agg(F.min(name).alias("class_id")), by, least)


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in ranges of `order` (null first), one a partition, written with `_range` and `_place`, the row's place in its range from 0 on. Rows that are equal in `order` lie in one range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return written(rows.withColumns({"_range": F.shiftright("_id", 33).cast("int"), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "ranged")


def in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's number in `order`, from 0 on: places in ranges, shifted by the counts of the ranges before, which are few."""
    rows = ranged(df, order)
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_below") + F.col("_place")).drop("_range", "_place", "_below")


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of its key `by` up to its own in `order` (distinct in a key). Sums run in a key's part of a range, and are shifted by those of its ranges before."""
    rows = ranged(df, [*by, order])
    part = [*by, "_range"]
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*part).agg(F.sum(value).alias("_s")).withColumn("_below", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inner = F.sum(value).over(Window.partitionBy(*part).orderBy(order))
    return rows.withColumn("_inner", inner).join(sums, part).withColumn(name, F.col("_below") + F.col("_inner")).drop("_range", "_place", "_below", "_inner")
