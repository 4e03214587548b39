"""Batch jobs over tile-request events and positions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tilewright.functions.mercator import EARTH_RADIUS_M
from tilewright.operators.staging import running_sum, written
from tilewright.operators.traffic import micros_of, refresh_version

WAVE = ["source_id", "generation", "scene_version"]


def latest_positions(positions: DataFrame) -> DataFrame:
    """(device, ts, lon, lat): the newest position of each device. Reduced before the shuffle."""
    return positions.groupBy("device").agg(F.max(F.struct("ts", "point_id", "lon", "lat")).alias("_l")).select("device", "_l.ts", "_l.lon", "_l.lat")


def apply_updates(snapshot: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """snapshot with the rows of known keys replaced by their last update. updates has the snapshot's columns and an order; unknown keys are left out."""
    cols = [c for c in snapshot.columns if c != key]
    last = updates.groupBy(key).agg(F.max(F.struct(order, *cols)).alias("_u"))
    return snapshot.join(last, key, "left").select(key, *[F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def drop_stale(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Events whose generation is the highest that their source had reached when they came."""
    reached = F.max("generation").over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_g", reached).filter("generation = _g").drop("_g")


def wave_summary(events: DataFrame) -> DataFrame:
    """Counts by state, and the span of a wave (source, generation, scene) in milliseconds."""
    return events.groupBy(*WAVE).agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("completed", "failed", "cancelled")], F.round(F.sum("total_ms"), 4).alias("total_ms"), ((micros_of(F.max("ts")) - micros_of(F.min("ts"))) / 1000).cast("long").alias("span_ms"))


def peak_concurrency(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, peak): the most requests under way at once. A request runs from ts to ts + total_ms; ends count before starts of the same time."""
    start = micros_of(F.col("ts"))
    ends = start + F.round(F.col("total_ms") * 1000).cast("long")
    steps = events.select(*by, F.explode(F.array(F.struct(start.alias("at"), F.lit(1).alias("d")), F.struct(ends.alias("at"), F.lit(-1).alias("d")))).alias("s")).select(*by, "s.at", "s.d")
    # Steps of one time are summed first, which also shrinks the shuffle.
    summed = steps.groupBy(*by, "at").agg(F.sum("d").alias("d"))
    return running_sum(summed, by, "at", "d", "n").groupBy(*by).agg(F.max("n").alias("peak"))


def request_timing(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "source_id").agg(
        F.count("*").alias("n"), F.round(F.avg("download_ms"), 6).alias("download_ms"), F.round(F.avg("decode_ms"), 6).alias("decode_ms"), F.round(F.max("total_ms"), 6).alias("worst_ms")
    ).select(F.col("w.start").alias("start"), "source_id", "n", "download_ms", "decode_ms", "worst_ms")


def failure_counts(events: DataFrame) -> DataFrame:
    """Failed requests by zoom and status, with what the user is told."""
    code = F.col("status_code")
    told = F.when(code.isin(401, 403), "authentication").when(code == 429, "throttled").when(code.isin(400, 404), "request").otherwise("other")
    return events.filter("state = 'failed'").groupBy("z", "status_code").agg(F.count("*").alias("n")).select("z", "status_code", "n", told.alias("user_class"))


def milestones(required: DataFrame, ready: DataFrame, fade_ms: int = 250) -> DataFrame:
    """(wave, first_tile, full_coverage, opaque_coverage): the first ready tile, the last if all required ones are ready, and the end of its fade."""
    first = ready.groupBy(*WAVE, "z", "x", "y").agg(F.min("ts").alias("at"))
    by = required.select(*WAVE, "z", "x", "y").distinct().join(first, [*WAVE, "z", "x", "y"], "left").groupBy(*WAVE).agg(F.min("at").alias("first_tile"), F.count("*").alias("_n"), F.count("at").alias("_m"), F.max("at").alias("_last"))
    full = F.when(F.col("_n") == F.col("_m"), F.col("_last"))
    return by.select(*WAVE, "first_tile", full.alias("full_coverage"), (full + F.expr(f"INTERVAL {fade_ms} MILLISECONDS")).alias("opaque_coverage"))


def changed_only(snapshots: DataFrame, by: str) -> DataFrame:
    """Snapshots (by, version, names) whose names differ from those of the version before; the first one counts as changed if it has any."""
    before = F.lag("names").over(Window.partitionBy(by).orderBy("version"))
    return snapshots.withColumn("_b", F.coalesce(before, F.array().cast("array<string>"))).filter(F.col("names") != F.col("_b")).drop("_b")


def cadence_windows(events: DataFrame, seconds: int) -> DataFrame:
    """(version, n, n_sources) of events by refresh version."""
    version = refresh_version(F.col("ts"), seconds)
    return events.groupBy(version.alias("version")).agg(F.count("*").alias("n"), F.countDistinct("device").alias("n_sources"))


#: Rows of a slice of time, as far as times tell them apart.
SLICE_ROWS = 50_000_000


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b, c, d = map(math.radians, (lat1, lon1, lat2, lon2))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, max(0.0, h))))


def movement_filter(positions: DataFrame, least_m: float = 5.0, least_s: float = 1.0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(device, point_id, ts, lon, lat) of a device's first position, and of each that lies least_m metres and least_s seconds from the last one that was passed on.

    Time is cut into slices of about `slice_rows` rows. Slices are folded in order: a slice's rows stream by, sorted by device and time, each device's after its last position so far, and leave
    what is passed on and each device's new last position, as tables. So a task holds one batch of rows, whatever a device's history. Positions with a null device, time or place are left out.
    """
    columns = ["device", "point_id", "ts", "lon", "lat"]
    rows = positions.select(*columns).dropna().withColumns({"_us": micros_of(F.col("ts")), "_state": F.lit(False)})
    n = rows.count()
    cuts = rows.approxQuantile("_us", [k / -(-n // slice_rows) for k in range(1, -(-n // slice_rows))], 0.001) if n > slice_rows else []
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    schema = rows.schema
    arrow = to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            device, lon, lat, us, state = (b.column(c).to_pylist() for c in ("device", "lon", "lat", "_us", "_state"))
            keep = []
            for k, d in enumerate(device):
                if d != now:
                    now, last = d, None
                if state[k]:
                    last = (us[k], lat[k], lon[k])
                elif last is None or (us[k] - last[0] >= least_s * 1e6 and metres(last[1], last[2], lat[k], lon[k]) >= least_m):
                    last = (us[k], lat[k], lon[k])
                    keep.append(k)
            yield b.take(pa.array(keep, pa.int64())).cast(arrow)

    out, state = None, None
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = rows if low is None else rows.filter(F.col("_us") > low)
        part = part if high is None else part.filter(F.col("_us") <= high)
        whole = part if state is None else part.unionByName(state)
        passed = written(whole.repartition("device").sortWithinPartitions("device", F.desc("_state"), "_us", "point_id").mapInArrow(fold, schema), "moved")
        out = passed if out is None else out.unionByName(passed)
        if high is not None:
            newest = passed.unionByName(state) if state is not None else passed
            own = F.struct("_us", "point_id", *[c for c in columns if c not in ("device", "point_id")])
            best = newest.groupBy("device").agg(F.max(own).alias("_m"))
            state = written(best.select("device", F.col("_m.point_id").alias("point_id"), *[F.col(f"_m.{c}").alias(c) for c in ("ts", "lon", "lat", "_us")]).withColumn("_state", F.lit(True)), "last")
    return out.select(*columns)
