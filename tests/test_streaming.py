"""Streams over files, one file a micro-batch, against batch twins."""

import tempfile

import pandas as pd
from oracle import SF
from pyspark.sql import functions as F

from tilewright.jobs.fixtures import view
from tilewright.operators import telemetry, traffic
from tilewright.streaming import jobs


def stream_of(spark, df, order, parts=3):
    """df dealt by order into files that are read one after another."""
    path = tempfile.mkdtemp(prefix="spark-")
    rows = df.orderBy(*order).collect()
    for k in range(parts):
        part = rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(out, mode, name):
    q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_latest_positions(spark):
    p = view(spark, SF, "points")
    run(jobs.latest_positions(stream_of(spark, p, ["ts"])), "complete", "latest")
    assert as_set(spark.table("latest")) == as_set(telemetry.latest_positions(p))


def test_hover_stream(spark):
    e = view(spark, SF, "pointer_events").withColumn("ts", F.col("ts").cast("timestamp"))
    run(jobs.hover_stream(stream_of(spark, e, ["ts"])), "append", "hover")
    assert as_set(spark.table("hover")) == as_set(traffic.hover_transitions(e))


def test_drop_stale_stream(spark):
    g = view(spark, SF, "points").select("device", F.col("point_id").alias("seq"), F.floor((F.col("point_id") * 37) % 1000 / 50).alias("generation"))
    run(jobs.drop_stale(stream_of(spark, g, ["seq"]), "device"), "append", "fresh")
    assert as_set(spark.table("fresh")) == as_set(telemetry.drop_stale(g, "device", ["seq"]).select("device", "seq", "generation"))


def test_movement_filter(spark):
    p = view(spark, SF, "points").withColumn("ts", F.col("ts").cast("timestamp")).withColumns({"lon": F.col("point_id") % 3 * 0.00003, "lat": F.col("value") * 0.0000002})
    run(jobs.movement_filter(stream_of(spark, p, ["ts"])), "append", "moved")
    want = set()
    for device, rows in p.toPandas().groupby("device"):
        rows = rows.sort_values(["ts", "point_id"], ignore_index=True)
        want |= {int(rows["point_id"][k]) for k in jobs.moved(rows, None, 5.0, 1.0)[0]}
    got = {r.point_id for r in spark.table("moved").collect()}
    assert got == want and 0 < len(got) < p.count()
    assert pd.Series(sorted(got)).is_unique


def test_windows_drop_late_rows(spark):
    p = view(spark, SF, "points").withColumn("ts", F.col("ts").cast("timestamp"))
    run(jobs.cadence_windows(stream_of(spark, p, ["ts"])), "append", "cadence")
    batch = p.groupBy(F.window("ts", "5 minutes")).count().select("window.start", "count")
    got = {(r.start, r.n) for r in spark.table("cadence").collect()}
    # In order of time no row is late: all windows but those that the watermark has not passed yet come out whole.
    newest = p.agg(F.max("ts")).first()[0]
    done = {w for w in as_set(batch) if (newest - w[0]).total_seconds() >= 15 * 60}
    assert done and done <= got <= as_set(batch)
