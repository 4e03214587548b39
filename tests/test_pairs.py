"""Joins of places give every pair of the rows that lie there."""

import pytest
from oracle import SF, database, same
from pyspark.sql import functions as F

from tilewright.jobs.queries import ORACLES, QUERIES
from tilewright.operators import geometry

BOX = "id long, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize(("chunk", "least"), [(1024, 1_000_000), (4, 5)])
def test_copies_of_boxes_are_all_paired(spark, monkeypatch, chunk, least):
    monkeypatch.setattr(geometry, "CHUNK", chunk)
    joined, met = geometry.bbox_join, []
    monkeypatch.setattr(geometry, "bbox_join", lambda a, b, *more: met.append((a.count(), b.count())) or joined(a, b, *more))
    box = lambda i, x: (i, x, 0.5, x + 0.01, 0.51)
    a = [*[box(i, 0.1) for i in range(30)], box(100, 0.8), (101, None, 0.5, 0.1, 0.51)]
    b = [*[box(i, 0.105) for i in range(200, 220)], box(300, 0.1), (301, None, 0.5, 0.1, 0.51)]
    got = geometry.bbox_pairs(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), least)
    assert met == [(2, 2)] and got.columns == ["a_id", "b_id"]
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i in range(30) for j in [*range(200, 220), 300])


@pytest.mark.parametrize(("chunk", "least"), [(1024, 1_000_000), (4, 5)])
def test_copies_of_points_are_all_paired(spark, monkeypatch, chunk, least):
    monkeypatch.setattr(geometry, "CHUNK", chunk)
    ring = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]
    shapes = geometry.align_contours(spark.createDataFrame([(p, 0, i, x, y) for p in (7, 8) for i, (x, y) in enumerate(ring)], "path_id long, contour int, i int, x double, y double"))
    points = spark.createDataFrame([*[(i, 0.5, 0.5) for i in range(40)], (50, 0.9, 0.9)], "point_id long, x double, y double")
    members, places = geometry.places_of(points, least)
    got = geometry.point_pairs(members, geometry.points_in_polygons(places, shapes), least)
    assert sorted(map(tuple, got.collect())) == [(i, p) for i in range(40) for p in (7, 8)]


@pytest.mark.parametrize(("name", "columns"), [("e06_bbox_join", ["a_id", "b_id"]), ("e07_points_in_polygons", ["point_id", "shape_id"]), ("e08_points_on_strokes", ["point_id", "shape_id"])])
def test_each_pair_has_a_row_where_events_repeat(spark, tmp_path, name, columns):
    """Events twice, 100,000 ids apart: at the same places."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.withColumn("event_id", (F.col("event_id") + 100_000).cast(events.schema["event_id"].dataType))).write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    once = QUERIES[name](spark, SF)
    twice = QUERIES[name](spark, str(tmp_path))
    assert once.columns == twice.columns == columns
    assert twice.count() == once.count() * (4 if name == "e06_bbox_join" else 2)
    db = database(SF)
    for t in ("events", "customer"):
        db.execute(f"create or replace view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    same(twice, db, ORACLES[name])
