"""Tiles are encoded and decoded many at a time, as rows stream by."""

import pytest
from pyspark.sql import functions as F

from tilewright.sources import archive, mvt

SCHEMA = "source_id long, z int, x int, y int, feature_seq int, source_layer string, geometry_type string, parts array<array<struct<x:double,y:double>>>, n long, t string"
SQUARE = [[(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)], [(0.125, 0.125), (0.125, 0.25), (0.25, 0.25), (0.25, 0.125)]]


def shapes(k):
    return [("Point", [[(k % 7 / 8, k % 5 / 8)]]), ("Point", [[(0.5, 0.25)], [(0.75, 0.5)]]), ("LineString", [[(0.0, 0.5), (0.25, 0.125)], [(0.5, 0.5), (0.125, 0.75), (1.0, 1.0)]]), ("Polygon", SQUARE)][k % 4]


@pytest.fixture
def features(spark):
    """Tiles of one to nine features, that end at and go on over the borders of batches; one has features without a layer alone."""
    rows = [(s, 5, s % 3, 0, k, None if s == 7 else "abc"[k % 3], *shapes(s + k), None if k % 4 == 1 else (s - 9) * 1000 + k, f"é{k}") for s in range(40) for k in range(1 + s % 9)]
    return rows, spark.createDataFrame(rows[::-1], SCHEMA)


def test_tiles_over_many_batches(spark, features):
    rows, df = features
    encoded = mvt.encode_tiles(df, ["n", "t"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = mvt.decode_vector_tiles(encoded).collect()
        assert encoded.count() == 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.error is None for r in got)
    number = {"Point": "points", "LineString": "lines", "Polygon": "polygons"}
    found = {}
    for r in got:
        kind = r.geometry_type.removeprefix("Multi")
        shape = [[tuple(p)] for p in r.points] if kind == "Point" else [[tuple(p) for p in q] for q in (r.lines if kind == "LineString" else r.polygons[0])]
        assert [c for c in number.values() if r[c]] == [number[kind]] and [c for c in number.values() if r[c] is None] == []
        found[r.source_id, r.props["t"].s] = (r.source_layer, kind, shape, r.props["n"].i if "n" in r.props else None)
    assert found == {(s, t): (name, kind, parts, n) for s, _, _, _, _, name, kind, parts, n, t in rows if name is not None}


def test_tiles_take_no_call_for_each(features):
    plan = mvt.decode_vector_tiles(mvt.encode_tiles(features[1], ["n", "t"]))._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 2


def test_an_archive_makes_its_tiles_once(spark, features, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    tiles = mvt.encode_tiles(features[1], ["n"])
    archive.write_tile_archive(tiles.mapInArrow(counted, tiles.schema), f"file://{tmp_path}/a")
    assert made.value == 40 and archive.read_tile_archive(spark, f"file://{tmp_path}/a").agg(F.count("*")).first()[0] == 40
