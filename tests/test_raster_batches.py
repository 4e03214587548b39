"""Raster tiles of a batch are done together: mixed sizes, missing buffers, and few calls."""

import numpy as np

from tilewright.jobs.q_sources import pixels, weighed
from tilewright.operators import raster
from pyspark.sql import functions as F

SCHEMA = "source_id long, z int, x int, y int, pixels binary"


def test_buffers_of_several_sizes(spark):
    rng = np.random.default_rng(1)
    of = lambda n: [rng.integers(0, 256, 4 * n, np.uint8).tobytes() for _ in range(2)]
    pairs = [of(1), of(4), [b"abc", b"abc"], [None, b"abcd"], of(4), of(2)]
    low, high = (spark.createDataFrame([(1, 5, i, 0, p[k]) for i, p in enumerate(pairs)], SCHEMA) for k in (0, 1))
    got = {r.x: r for r in weighed(raster.composite_tiles(low, high)).collect()}
    for i, (b, o) in enumerate(pairs):
        if i in (2, 3):
            assert got[i].total is None and got[i].error
        else:
            assert got[i].total == sum(k * v for k, v in enumerate(raster.composited(b, o), 1)) and got[i].error is None


def test_crops_of_several_parents(spark):
    whole = np.arange(8 * 8 * 4, dtype=np.uint8).reshape(8, 8, 4)
    small = spark.createDataFrame([(1, 3, 0, 0, whole.tobytes(), 8, 8), (1, 3, 1, 0, b"abcd", 1, 1)], SCHEMA + ", width int, height int")
    tiles = spark.createDataFrame([(1, 4, 0, 0), (1, 5, 3, 2), (1, 4, 2, 1)], "source_id long, z int, x int, y int")
    got = {(r.z, r.x, r.y): r for r in raster.crop_overzoom(small, tiles).collect()}
    a, b, c = got[4, 0, 0], got[5, 3, 2], got[4, 2, 1]
    assert a.pixels == whole[0:5, 0:5].tobytes() and (a.width, a.height, a.scale_x, a.shift_x, a.error) == (5, 5, 0.8, 0.0, None)
    assert b.pixels == whole[3:7, 5:8].tobytes() and (b.width, b.height, b.parent_z) == (3, 4, 3) and b.shift_x == 1 / 3
    assert c.error and c.pixels is None and c.width is None and c.scale_x is None and c.parent_z == 3


def test_pixels_are_looked_up(spark):
    df = spark.createDataFrame([(3,), (300,), (-1,)], "s int").select("s", pixels(F.col("s"), 2).alias("p"))
    assert {r.s: bytes(r.p) for r in df.collect()} == {s: bytes((s * 7 + k * 31) % 256 for k in range(8)) for s in (3, 300, -1)}
    assert "lpad" not in df._jdf.queryExecution().toString()
