"""Structured Streaming jobs over positions, pointers and request events; each has a batch twin in operators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilewright.functions.mercator import EARTH_RADIUS_M


def latest_positions(stream: DataFrame) -> DataFrame:
    """The newest position of each device; for output mode update or complete."""
    return stream.groupBy("device").agg(F.max(F.struct("ts", "point_id", "lon", "lat")).alias("_l")).select("device", "_l.ts", "_l.lon", "_l.lat")


def cadence_windows(stream: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by refresh window; those later than `late` behind the newest are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.approx_count_distinct("device").alias("n_devices")).select(F.col("window.start").alias("start"), "n", "n_devices")


def request_timing(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "source_id").agg(F.count("*").alias("n"), F.avg("download_ms").alias("download_ms"), F.avg("decode_ms").alias("decode_ms"), F.percentile_approx("total_ms", 0.95).alias("p95_ms")).select(F.col("window.start").alias("start"), "source_id", "n", "download_ms", "decode_ms", "p95_ms")


def ordered(batches: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of a micro-batch, in order."""
    parts = list(batches)
    return pd.concat(parts).sort_values(list(by), ignore_index=True) if parts else pd.DataFrame()


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b, c, d = np.radians([lat1, lon1, lat2, lon2])
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return float(2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(min(1.0, max(0.0, h)))))


def moved(rows: pd.DataFrame, last: tuple | None, least_m: float, least_s: float) -> tuple[list[int], tuple | None]:
    """Numbers of the rows to emit, and the last emitted (ts, lat, lon): the first row of a device, then those far enough and late enough from it."""
    out = []
    for k, r in enumerate(rows.itertuples(index=False)):
        if last is None or (metres(last[1], last[2], r.lat, r.lon) >= least_m and (r.ts - last[0]).total_seconds() >= least_s):
            out.append(k)
            last = (r.ts, float(r.lat), float(r.lon))
    return out, last


def movement_filter(stream: DataFrame, least_m: float = 5.0, least_s: float = 1.0, forget_ms: int = 86_400_000) -> DataFrame:
    """(device, point_id, ts, lon, lat) only after a move of least_m metres and least_s seconds since a device's last emitted row. A device's state goes after `forget_ms` without rows."""

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = ordered(batches, "ts", "point_id")
        last = state.get if state.exists else None
        keep, last = moved(rows, None if last is None else (pd.Timestamp(last[0], unit="us"), last[1], last[2]), least_m, least_s)
        if last is not None:
            state.update((int(pd.Timestamp(last[0]).value // 1000), last[1], last[2]))
        state.setTimeoutDuration(forget_ms)
        yield rows.iloc[keep][["device", "point_id", "ts", "lon", "lat"]]

    kind = stream.schema["ts"].dataType.simpleString()
    return stream.groupBy("device").applyInPandasWithState(step, f"device long, point_id long, ts {kind}, lon double, lat double", "ts long, lat double, lon double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def hover_stream(stream: DataFrame, forget_ms: int = 86_400_000) -> DataFrame:
    """(pointer_id, ts, exited, entered) where a pointer's target changes, over micro-batches; -1 in the state stands for no target."""

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = ordered(batches, "ts", "event_id")
        now = rows["target"].astype("Int64")
        before = now.shift(1)
        before.iloc[0] = state.get[0] if state.exists and state.get[0] >= 0 else pd.NA
        same = ((now == before) | (now.isna() & before.isna())).fillna(False).astype(bool)
        state.update((-1 if pd.isna(now.iloc[-1]) else int(now.iloc[-1]),))
        state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame({"pointer_id": rows["pointer_id"], "ts": rows["ts"], "exited": before, "entered": now})[~same]

    kind = stream.schema["ts"].dataType.simpleString()
    return stream.groupBy("pointer_id").applyInPandasWithState(step, f"pointer_id long, ts {kind}, exited long, entered long", "target long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drop_stale(stream: DataFrame, by: str, forget_ms: int = 86_400_000) -> DataFrame:
    """Rows (by, seq, generation) whose generation is the highest that their key has reached so far."""

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = ordered(batches, "seq")
        top = np.maximum.accumulate(np.maximum(rows["generation"].to_numpy(), state.get[0] if state.exists else np.iinfo(np.int64).min))
        state.update((int(top[-1]),))
        state.setTimeoutDuration(forget_ms)
        yield rows[rows["generation"].to_numpy() == top][[by, "seq", "generation"]]

    return stream.groupBy(by).applyInPandasWithState(step, f"`{by}` long, seq long, generation long", "generation long", "append", GroupStateTimeout.ProcessingTimeTimeout)
