"""Points along paths of a few segments, where the distance behind the point is cut to the path's end: the query and its SQL agree on them."""

import duckdb
from oracle import same
from pyspark.sql import functions as F

from tilewright.jobs.queries import ORACLES, QUERIES


def test_points_near_the_end_of_short_paths(spark, tmp_path):
    """Users of 1 to 42 events, laid out so that sums by different orders differ in their last bit for some."""
    k = F.col("event_id") % 900
    users = F.floor(F.sqrt(2 * k)) + 45 * F.floor(F.col("event_id") / 900)
    e = spark.range(27_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_600_000_000).alias("ts")).withColumn("user_id", users.cast("long"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = QUERIES["e13_point_along"](spark, str(tmp_path))
    assert got.filter("x IS NULL OR tangent_x IS NULL").isEmpty()
    same(got, db, ORACLES["e13_point_along"])
