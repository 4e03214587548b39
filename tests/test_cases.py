"""Exact cases of the functions and jobs."""

import datetime
import json
import math
import os
import tempfile
from collections import defaultdict

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from tilewright.functions import colors, rules
from tilewright.functions import mercator as M
from tilewright.jobs.fixtures import view
from tilewright.jobs.queries import QUERIES
from tilewright.operators import cache, evaluate, geometry, hittest, labels, raster, styles, tiles
from tilewright.sources import mvt, tables

MIB = 1 << 20


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("zoom,size,want", [(8.9, 256, 8), (8.9, 512, 7), (8.9, 128, 9), (8.9, 1, 11), (0.0, 512, 0), (0.99, 512, 0), (0.0, 1024, 0), (1.0, 1024, 0)])
def test_source_zoom(spark, zoom, size, want):
    assert value(spark, M.source_zoom(F.lit(zoom), F.lit(size))) == want


def test_scalars(spark):
    assert value(spark, M.quadkey(F.lit(4), F.lit(9), F.lit(5))) == "1203" and value(spark, M.quadkey(F.lit(0), F.lit(0), F.lit(0))) == ""
    assert value(spark, M.normalize_longitude(F.lit(540.0))) == 180 and value(spark, M.normalize_longitude(F.lit(-180.0))) == -180 and value(spark, M.normalize_longitude(F.lit(float("inf")))) == 0
    assert 22_000 < value(spark, M.haversine_m(F.lit(0.0), F.lit(179.9), F.lit(0.0), F.lit(-179.9))) < 22_500
    assert value(spark, M.project_to_viewport(*[F.lit(float(x)) for x in (float("nan"), 0, 0, 0, 1, 100, 100, 0, 0)])) is None
    assert value(spark, M.expand_tile_url(F.lit("https://t/{z}/{x}/{y}.png"), F.lit(3), F.lit(2), F.lit(5))) == "https://t/3/2/5.png"
    assert value(spark, M.is_valid_tile_template(F.lit("https://{subdomain}.t/{z}"))) and not value(spark, M.is_valid_tile_template(F.lit("https://t/{unknown}")))


@pytest.mark.parametrize("protected,want", [(0, 32), (15, 32), (32, 48), (112, 128), (160, 160)])
def test_cache_budget(spark, protected, want):
    assert value(spark, cache.budget(F.lit(protected * MIB))) == want * MIB


def test_four_tiles(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 512.0, 512.0, 0.0, 0.0)], "scene_id long, lon double, lat double, zoom double, vw double, vh double, heading double, pitch double")
    assert [tuple(r) for r in tiles.visible_tiles(s).orderBy("tile_index").select("z", "x", "y").collect()] == [(1, 0, 0), (1, 1, 0), (1, 0, 1), (1, 1, 1)]


@pytest.mark.parametrize("a,b,want", [((4, 2, 3), (5, 5, 6), 1), ((4, 2, 3), (5, 6, 6), 0), ((5, 31, 6), (4, 0, 3), 0)])
def test_overlap(spark, a, b, want):
    t = lambda v: spark.createDataFrame([(1, *v)], "source_id long, z int, x int, y int")
    assert tiles.overlapping(t(a), t(b)).count() == want


def test_pitched_scene_matches_plain_arithmetic(spark):
    """The corners of a turned and pitched view, by hand."""
    rows = [(i, -100.0 + 40 * i, 50.0 - 20 * i, 3.25 + i, 800.0, 600.0, 37.0 * i, 15.0 * i) for i in range(5)]
    s = spark.createDataFrame(rows, "scene_id long, lon double, lat double, zoom double, vw double, vh double, heading double, pitch double")
    got = {r.scene_id: (r.x0, r.x1, r.y0, r.y1) for r in tiles.visible_tiles(s).groupBy("scene_id").agg(F.min("world_x").alias("x0"), F.max("world_x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect()}
    for i, lon, lat, zoom, w, h, heading, pitch in rows:
        z = math.floor(zoom)
        size = 256 * 2 ** (zoom - z)
        cx = (lon + 180) / 360 * size * 2**z
        phi = math.radians(lat)
        cy = (1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * size * 2**z
        a, t, far = math.radians(pitch), -math.radians(heading), h * 0.5 / math.tan(math.radians(20))
        xs, ys = [], []
        for x in (-w / 2, w / 2):
            for y in (-h / 2, h / 2):
                fy = y * far / (far * math.cos(a) + y * math.sin(a)) if a else y
                fx = x * (far - fy * math.sin(a)) / far if a else x
                xs.append(fx * math.cos(t) + fy * math.sin(t))
                ys.append(fy * math.cos(t) - fx * math.sin(t))
        want = (math.floor((cx + min(xs)) / size), math.floor((cx + max(xs) - 1e-7) / size), max(0, math.floor((cy + min(ys)) / size)), min(2**z - 1, math.floor((cy + max(ys) - 1e-7) / size)))
        assert got[i] == want


def test_dateline_path_and_ties(spark):
    v = spark.createDataFrame([(1, 0, 0, 179.0, 0.0), (1, 0, 1, -179.0, 0.0), (2, 0, 0, -90.0, 0.0), (2, 0, 1, 90.0, 0.0), (2, 0, 2, -90.0, 0.0), (3, 0, 0, 0.0, 0.0), (3, 0, 1, 0.0, 0.0), (3, 0, 2, 5.0, 1.0), (3, 0, 3, 0.0, 0.0), (4, 0, 0, float("nan"), 0.0)], "path_id long, contour int, i int, lon double, lat double")
    got = defaultdict(list)
    for r in geometry.build_paths(v).orderBy("path_id", "i").collect():
        got[r.path_id].append(r.x)
    assert abs(got[1][1] - got[1][0]) < 0.01
    x = [0.25]
    for w in (0.75, 0.25):
        x.append(w + round(x[-1] - w))
    assert got[2] == x[: len(got[2])] and len(got[3]) == 2 and 4 not in got


def test_polygon_with_hole(spark):
    ring = lambda c, s: [(1, c, i, x * s, y * s) for i, (x, y) in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1)])]
    v = spark.createDataFrame([(p, c, i, float(x), float(y)) for p, c, i, x, y in ring(0, 2.0) + ring(1, 0.5)], "path_id long, contour int, i int, lon double, lat double")
    at = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 3.0, 0.0), (4, 2.0, 0.0)], "point_id long, lon double, lat double").select("point_id", M.lon_to_world_x(F.col("lon")).alias("x"), M.lat_to_world_y(F.col("lat")).alias("y"))
    assert {r.point_id for r in geometry.points_in_polygons(at, geometry.align_contours(geometry.build_paths(v))).collect()} == {2, 4}


def test_shapes_around_the_world(spark):
    """A band from one end of the world to the other holds each point once, and so does the whole world."""
    ring = lambda p, n, s: [(p, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(-180, s), (-60, s), (60, s), (180, s), (180, n), (60, n), (-60, n), (-180, n)])]
    v = spark.createDataFrame(ring(1, 10, -10) + ring(2, 85, -85) + [(3, 0, i, x, y) for i, (x, y) in enumerate([(170.0, 0.0), (-170.0, 0.0), (-170.0, 20.0), (170.0, 20.0)])], "path_id long, contour int, i int, lon double, lat double")
    at = [(1, -179.0, 0.0), (2, 179.0, 0.0), (3, 0.0, 5.0), (4, 0.0, 40.0), (5, -175.0, 15.0), (6, 175.0, 15.0)]
    points = spark.createDataFrame(at, "point_id long, lon double, lat double").select("point_id", M.lon_to_world_x(F.col("lon")).alias("x"), M.lat_to_world_y(F.col("lat")).alias("y"))
    got = sorted((r.point_id, r.path_id) for r in geometry.points_in_polygons(points, geometry.align_contours(geometry.build_paths(v))).collect())
    assert got == sorted([(i, 2) for i in range(1, 7)] + [(1, 1), (2, 1), (3, 1)] + [(1, 3), (2, 3), (5, 3), (6, 3)])


def even_odd(rings, px, py):
    inside = False
    for ring in rings:
        for (x, y), (nx, ny) in zip(ring, ring[1:] + ring[:1]):
            if (y > py) != (ny > py) and px < (nx - x) * (py - y) / (ny - y) + x:
                inside = not inside
    return inside


def test_many_edges_and_many_sizes(spark):
    """Stars of very different sizes, one with thousands of edges."""
    rng = np.random.default_rng(7)
    shapes = {}
    for k in range(12):
        n, r = (3000 if k == 0 else int(rng.integers(3, 60))), 10.0 ** -rng.uniform(0.5, 4)
        cx, cy = rng.uniform(0.2, 0.8, 2)
        turn = np.sort(rng.uniform(0, 2 * np.pi, n))
        far = r * rng.uniform(0.2, 1, n)
        shapes[k] = list(zip((cx + far * np.cos(turn)).tolist(), (cy + far * np.sin(turn)).tolist()))
    rows = [(k, 0, i, x, y) for k, ring in shapes.items() for i, (x, y) in enumerate(ring)]
    v = geometry.align_contours(spark.createDataFrame(rows, "path_id long, contour int, i int, x double, y double"))
    where = [(float(x), float(y)) for k in shapes for x, y in np.mean(shapes[k], axis=0) + rng.normal(size=(40, 2)) * np.std(shapes[k], axis=0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(where)], "point_id long, x double, y double")
    got = {(r.point_id, r.path_id) for r in geometry.points_in_polygons(points, v).collect()}
    assert got == {(i, k) for i, (x, y) in enumerate(where) for k, ring in shapes.items() if even_odd([ring], x, y)} and len(got) > 50


def test_strokes(spark):
    """A path with a corner: square ends, a round corner, and nothing beyond."""
    line = spark.createDataFrame([(1, 0, i, x, y) for i, (x, y) in enumerate([(0.1, 0.1), (0.2, 0.1), (0.2, 0.2)])], "path_id long, contour int, i int, x double, y double")
    at = [(0.15, 0.109), (0.15, 0.111), (0.099, 0.1), (0.206, 0.094), (0.209, 0.091), (0.2, 0.2005), (0.195, 0.15)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "point_id long, x double, y double")
    assert {r.point_id for r in geometry.points_on_strokes(points, geometry.segments(line), F.lit(0.02)).collect()} == {0, 3, 6}
    straight = spark.createDataFrame([(1, 0, i, x, 0.5) for i, x in enumerate([0.1, 0.2, 0.3])], "path_id long, contour int, i int, x double, y double")
    assert geometry.points_on_strokes(spark.createDataFrame([(1, 0.2, 0.5)], "point_id long, x double, y double"), geometry.segments(straight), F.lit(0.02)).count() == 1


def test_contours_without_a_path_are_named(spark):
    v = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, float("nan"), 0.0), (2, 0, 0, 1.0, 1.0), (3, 0, 0, None, 1.0)], "path_id long, contour int, i int, lon double, lat double")
    long = spark.range(geometry.MOST_POINTS + 1).select(F.lit(4).cast("long").alias("path_id"), F.lit(0).alias("contour"), F.col("id").cast("int").alias("i"), (F.col("id") % 90).cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    got = {r.path_id: r.error for r in geometry.path_errors(v.unionByName(long)).collect()}
    assert got == {1: "a position is not finite", 3: "a position is not finite", 4: "too many points"}


def test_collisions(spark):
    rows = QUERIES["h04_resolve_collisions"](spark, SF).count()
    c = labels.collision_candidates(labels.collision_groups(view(spark, SF, "placements")))
    key = lambda r: (r.scene_id, r.symbol_group, r.placement_index, r.component)
    got = {key(r): r.accepted for r in labels.resolve_collisions(c).collect()}
    scenes = defaultdict(list)
    for r in c.collect():
        scenes[r.scene_id].append(r)
    want = {}
    for items in scenes.values():
        taken = []
        for r in sorted(items, key=lambda r: (-r.style_order, r.sort_key, r.seq)):
            b = (r.x0 - r.padding, r.y0 - r.padding, r.x1 + r.padding, r.y1 + r.padding)
            hit = any(f != r.family and t[0] < b[2] and t[2] > b[0] and t[1] < b[3] and t[3] > b[1] for t, f in taken)
            want[key(r)] = ok = bool(r.allow_overlap or not hit)
            if ok and not r.ignore_placement:
                taken.append((b, r.family))
    assert got == want and rows == len(want) and 0 < sum(want.values()) < len(want)


def test_hull_and_offset(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(500, 2))
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in pts], "g long, x double, y double")
    got = [(r.x, r.y) for r in geometry.convex_hull(df, "g").orderBy("k").collect()]
    assert sorted(got) == sorted(map(tuple, geometry.hull_of(pts[:, 0], pts[:, 1]).tolist()))
    for a, b in zip(got, got[1:] + got[:1]):
        assert ((b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0]) >= -1e-12).all()
    assert QUERIES["e19_convex_hull"](spark, SF).groupBy("path_id").count().filter("count < 3").count() == 0

    def moved(*points):
        line = spark.createDataFrame([(1, 0, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "path_id long, contour int, i int, x double, y double")
        return [(round(r.x, 6) + 0.0, round(r.y, 6) + 0.0) for r in geometry.offset_paths(line, 0.5).orderBy("i").collect()]

    assert moved((0, 0), (2, 0), (2, 2)) == [(0.0, -0.5), (2.5, -0.5), (2.5, 2.0)]
    assert moved((0, 0), (2, 0), (0, 0)) == [(0.0, -0.5), (2.0, 0.5), (0.0, -0.5)]  # back the way it came: a closed path of two sides
    assert moved((0, 0), (2, 0), (1, 0)) == [(0.0, -0.5), (2.0, 0.5), (1.0, 0.5)]  # a U-turn: the next side's normal
    sharp = moved((0, 0), (2, 0), (0, 0.1))[1]
    assert math.hypot(sharp[0] - 2, sharp[1]) == pytest.approx(0.5)  # a sharp turn: once the offset
    ring = moved((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
    assert ring[0] == ring[4] == (-0.5, -0.5)


def test_paint_that_is_hidden_may_be_out_of_range(spark):
    n = lambda *v: [F.lit(float(x)) for x in v]
    assert value(spark, evaluate.evaluate_line(*n(300, 0, 0, 0, 2, 0, 1))) == "hidden" and value(spark, evaluate.evaluate_line(*n(300, 0, 0, 0, 2, 1, 1))) == "invalid"
    assert value(spark, evaluate.evaluate_extrusion(*n(5, 5, 1))) == "drawn"
    assert value(spark, evaluate.evaluate_fill(*n(0, 0, 1, 0, 1))) == "drawn" and value(spark, evaluate.evaluate_fill(*n(0, 0, 1, 0, 0))) == "hidden"


def plain_fit(west, south, east, north, w, h, margins, heading, pitch):
    """A slow search by the projection column's arithmetic, in plain numbers."""
    left, top, right, bottom = margins
    wx = lambda v: ((v + 180) % 360) / 360 if not ((v + 180) % 360 == 0 and v > 0) else 1.0
    wy = lambda v: (1 - math.log(math.tan(math.radians(v)) + 1 / math.cos(math.radians(v))) / math.pi) / 2
    a, t, far = math.radians(pitch), math.radians(heading), max(1.0, h * 0.5 / math.tan(math.radians(20)))
    mx, my = (wx(west) + wx(east)) / 2, (wy(south) + wy(north)) / 2
    ox, oy = (left - right) / 2, (top - bottom) / 2
    fy = oy * far / (far * math.cos(a) + oy * math.sin(a))
    fx = ox * (far - fy * math.sin(a)) / far

    def fits(z):
        size = 256 * 2**z
        cx, cy = mx - (fx * math.cos(t) - fy * math.sin(t)) / size, min(1, max(0, my - (fy * math.cos(t) + fx * math.sin(t)) / size))
        for lon, lat in ((west, north), (east, north), (east, south), (west, south)):
            x, y = (wx(lon) - cx - round(wx(lon) - cx)) * size, (wy(lat) - cy) * size
            x, y = x * math.cos(t) + y * math.sin(t), y * math.cos(t) - x * math.sin(t)
            k = far / max(1.0, far - y * math.sin(a))
            x, y = x * k + w / 2, y * math.cos(a) * k + h / 2
            if not (left - 0.5 <= x <= w - right + 0.5 and top - 0.5 <= y <= h - bottom + 0.5):
                return False
        return True

    z = 22.0
    while z > 0 and not fits(z):
        z -= 1 / 64
    if not fits(z):
        return None
    low, high = z, min(22.0, z + 1 / 64)
    for _ in range(48):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def test_fit_groups(spark):
    got = {r.device: r for r in QUERIES["c10_fit_groups"](spark, SF).collect()}
    boxes = defaultdict(list)
    for r in view(spark, SF, "points").select("device", (F.col("lon") / 40 + F.col("device") % 300 - 150).alias("lon"), (F.col("lat") / 3).alias("lat")).collect():
        boxes[r.device].append((r.lon, r.lat))
    for device, at in boxes.items():
        lon, lat = zip(*at)
        want = plain_fit(min(lon), min(lat), max(lon), max(lat), 1024, 768, (20, 40, 60, 10), 30, 20)
        assert (got[device].zoom is None) == (want is None) and (want is None or abs(got[device].zoom - want) < 1e-6)
    assert any(r.zoom is not None for r in got.values())
    one = tiles.fit_views(*[np.array([v]) for v in (0.0, 10.0, -5.0, 0.0)], 512, 512, (0, 0, 0, 0), 0, 0)
    assert np.isnan(one[2][0])  # south lies north of north


def test_exclusive_coverage(spark):
    """Areas against points of a fine grid, each of which the first tile over it takes."""
    rng = np.random.default_rng(11)
    chosen = {(z, int(rng.integers(0, 1 << z)), int(rng.integers(0, 1 << z))) for z in (1, 2, 3) for _ in range(4 * z)}
    rows = [(1, 7, z, x, y, x, x * 512.0 / 2**z, y * 512.0 / 2**z, 512.0 / 2**z) for z, x, y in chosen]
    inst = spark.createDataFrame(rows, "scene_id long, source_id long, z int, x int, y int, world_x int, `left` double, top double, size double")
    for active in (1, 2, 3):
        out = tiles.exclusive_coverage(inst, spark.createDataFrame([(1, active)], "scene_id long, zoom_level int")).collect()
        got = defaultdict(float)
        for r in out:
            got[(r.z, r.x, r.y)] += (r.right - r.left) * (r.bottom - r.top)
        want = defaultdict(float)
        order = sorted(chosen, key=lambda t: (t[0] != active, -t[0], t[2], t[1]))
        for gx in range(16):
            for gy in range(16):
                px, py = gx * 32 + 16, gy * 32 + 16
                first = next((t for t in order if t[1] == int(px * 2 ** t[0] / 512) and t[2] == int(py * 2 ** t[0] / 512)), None)
                if first:
                    want[first] += 32 * 32
        assert {k: round(v, 6) for k, v in got.items()} == dict(want)


def test_eviction_over_slots(spark):
    """Slots of any width give what one order over the pool gives."""
    rng = np.random.default_rng(5)
    rows = [(int(k % 3), 5, k, 0, int(rng.integers(1, 50)), datetime.datetime(2020, 1, 1 + int(rng.integers(0, 20)), int(rng.integers(0, 24)))) for k in range(300)]
    c = spark.createDataFrame(rows, "source_id long, z int, x int, y int, bytes long, last_used timestamp_ntz")
    kept = c.filter("x % 7 = 0")
    want = set()
    for pool in range(3):
        own = [r for r in rows if r[0] == pool]
        total = sum(r[4] for r in own)
        for r in sorted((r for r in own if r[2] % 7), key=lambda r: (r[5], r[:4])):
            if total <= 1000:
                break
            total -= r[4]
            want.add(r[:4])
    for slot in (None, F.date_trunc("month", "last_used"), F.col("last_used")):
        assert {(r.source_id, r.z, r.x, r.y) for r in cache.lru_evict(c, kept, limit=F.lit(1000), slot=slot).collect()} == want


BROKEN = {
    "a ring is not closed": (3, [9, 0, 0, 18, 20, 0, 0, 20]), "a polygon starts with a hole": (3, [9, 0, 0, 18, 0, 20, 20, 0, 15]), "a ring has no area": (3, [9, 0, 0, 18, 20, 0, 20, 0, 15]), "a line has fewer than two points": (2, [9, 0, 0]),
    "a feature has no geometry": (1, []), "a geometry's command is not valid": (1, [10, 0, 0]),
}


def tile_of(kind, commands, tags=(), values=(b"\x0a\x01a",), after=False, extra=b""):
    packed = lambda v: b"".join(map(mvt.number, v))
    feature = mvt.field(2, packed(tags)) + mvt.number(24) + mvt.number(kind) + (mvt.field(4, packed(commands)) if commands else b"")
    head = mvt.field(1, b"layer") + mvt.field(3, b"k") + b"".join(mvt.field(4, v) for v in values) + mvt.number(40) + mvt.number(4096)
    return mvt.field(3, mvt.field(2, feature) + head if after else head + mvt.field(2, feature)) + extra


def test_broken_tiles(spark):
    tiles_ = {name: tile_of(*how) for name, how in BROKEN.items()}
    tiles_ |= {"a feature's tags are no pairs, or too many": tile_of(1, [9, 2, 2], [0]), "a tag is out of range": tile_of(1, [9, 2, 2], [0, 4]), "a value has several types": tile_of(1, [9, 2, 2], values=(b"\x0a\x01a\x38\x01",)), "a text is not valid UTF-8": tile_of(1, [9, 2, 2], values=(b"\x0a\x01\xff",)), "a field is longer than the tile": tile_of(1, [9, 2, 2], extra=b"\x1a\x7f")}
    df = spark.createDataFrame([(k, 1, 0, 0, bytearray(v)) for k, v in enumerate(tiles_.values())], "source_id long, z int, x int, y int, content binary")
    got = {r.source_id: r for r in mvt.decode_vector_tiles(df).collect()}
    assert [got[k].error for k in range(len(tiles_))] == list(tiles_) and all(r.source_layer is None for r in got.values())


def test_sound_tiles(spark):
    """Metadata after features, equal keys (the last counts), unknown kinds (left out), every type of value."""
    values = (b"\x0a\x01a", b"\x15" + np.float32(1.5).tobytes(), b"\x19" + np.float64(-2.5).tobytes(), b"\x20" + mvt.number((1 << 64) - 3), b"\x28" + mvt.number((1 << 64) - 1), b"\x30" + mvt.number(5), b"\x38\x01")
    contents = [tile_of(1, [9, 2, 4], [0, k, 0, j], values, after=True) for k, j in zip(range(7), [1, 2, 3, 4, 5, 6, 0])] + [tile_of(4, [9, 2, 2]), b"", None, tile_of(2, [9, 0, 0, 10, 8, 6, 9, 2, 2, 10, 2, 2])]
    df = spark.createDataFrame([(k, 1, 0, 0, None if v is None else bytearray(v)) for k, v in enumerate(contents)], "source_id long, z int, x int, y int, content binary")
    rows = {r.source_id: r for r in mvt.decode_vector_tiles(df).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 6, 10] and all(r.error is None for r in rows.values())
    p = {k: rows[k].props["k"] for k in range(7)}
    assert [p[k].kind for k in range(7)] == ["float", "double", "int", "uint", "sint", "bool", "string"]
    assert [p[0].d, p[1].d, p[2].i, int(p[3].u), p[4].i, p[5].b, p[6].s] == [1.5, -2.5, -3, (1 << 64) - 1, -3, True, "a"]
    assert rows[0].points == [(1 / 4096, 2 / 4096)] and rows[10].geometry_type == "MultiLineString" and [len(v) for v in rows[10].lines] == [2, 2]


def test_tile_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for name, size in (("5/3/1/2", 10), ("5/3/1/4", 3000)):
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        open(f"{folder}/{name}.pbf", "wb").write(b"x" * size)
    got = {(r.source_id, r.z, r.x, r.y): (r.error, r.content and len(r.content)) for r in mvt.read_tile_blobs(spark, folder, most=100).collect()}
    assert got == {(5, 3, 1, 2): (None, 10), (5, 3, 1, 4): ("the tile is too large", None)}


def test_places_and_telemetry_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    p = view(spark, SF, "places")
    for _ in range(2):  # the second one replaces the first
        tables.write_places(p, f"{folder}/p", ["name", "place_id"])
    got = spark.read.parquet(f"{folder}/p")
    assert sorted(r.item for r in got.collect()) == list(range(p.count())) and {r.n_items for r in got.collect()} == {p.count()}
    os.makedirs(f"{folder}/e")
    open(f"{folder}/e/a.json", "w").write("\n".join(json.dumps({"id": k, "level": tables.LEVELS[k % 5], "keywords": 1 << k % 11}) for k in range(60)))
    rows = tables.read_telemetry(spark, f"{folder}/e", "id long, level string, keywords long", "warning", 8 | 64).collect()
    assert sorted(r.id for r in rows) == [k for k in range(60) if k % 5 < 3 and k % 11 in (3, 6)]


def test_a_style_document_resolves(spark):
    """From JSON to drawn features: layers come from the table, and rules from their texts."""
    layers = styles.layers_of(tables.read_style(view(spark, SF, "styles").filter("style_id = 1"), keep=("style_id",)))
    f = view(spark, SF, "features").withColumn("opt", F.when(F.col("feature_id") % 4 != 0, F.col("level")))
    got = {(r.feature_id, r.layer_id): r for r in styles.resolve_layers(f, layers, 7.0, ["opt", "name"]).collect()}
    roads = {r.feature_id for r in f.filter("source_layer = 'road' AND opt IS NOT NULL").collect()}
    assert {i for i, layer in got if layer == "roads"} == roads and all(r["line-color"] == "#f00" for (_, layer), r in got.items() if layer == "roads")
    plan = styles.resolve_layers(f, layers, 7.0, ["opt", "name"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


def test_colors(spark):
    """Halves of channels go to the even number, channels are free of their opacity, and what is no colour is null."""
    text = lambda t: value(spark, colors.color_text(colors.parse_color(F.lit(t))))
    assert text("#abc") == "#AABBCCFF" and text("#11223380") == "#11223380" and text("rgba(10,20,30,0)") == "#00000000" and text("hsl(240,100%,50%)") == "#0000FFFF" and text("blue") is None
    assert value(spark, colors.lerp_color(F.lit("#ff000000"), F.lit("#ff0000ff"), F.lit(0.5))) == "#FF000080" and value(spark, colors.lerp_color(F.lit("#fff"), F.lit("white"), F.lit(0.5))) is None


def test_dashes_that_are_not_valid(spark):
    line = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, 10.0, 0.0)], "path_id long, contour int, i int, x double, y double")
    for bad in ([1.0], [0.0, 0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            geometry.dash_pattern(geometry.segments(line), bad, 1.0)
    assert [(r.x, r.nx) for r in geometry.dash_pattern(geometry.segments(line), [], 1.0).collect()] == [(0.0, 10.0)]
    # An odd pattern is taken twice: on 1, off 2, on 1, off 1, on 2, off 1, of which the line of 10 shows one period and a half.
    assert sorted((r.x, r.nx) for r in geometry.dash_pattern(geometry.segments(line), [1.0, 2.0, 1.0], 1.0).collect()) == [(0.0, 1.0), (3.0, 4.0), (5.0, 7.0), (8.0, 9.0)]


def test_rules_that_are_not_valid():
    scope = rules.Scope({})
    for bad in (["nope"], ["var", "x"], ["step", 1, "a", 2, "b", 1, "c"], [3]):
        with pytest.raises((rules.RuleError, AssertionError)):
            rules.compile_expression(json.loads(json.dumps(bad)), scope)


@pytest.mark.parametrize("name", ["c04_request_tiles", "c05_cache_lookup", "c06_missing_tiles", "c07_coverage", "c12_cached_instances", "c19_exclusive_coverage"])
def test_tables_that_grow_are_not_sent_to_all_tasks(spark, name):
    """Small as they are here, the driver would hold them whole where they are large."""
    df = QUERIES[name](spark, SF)
    df.collect()
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_hulls_of_many_keys_at_once():
    rng = np.random.default_rng(5)
    own = [rng.integers(0, 9, (n, 2)).astype(float) for n in range(1, 40)]
    # An arc whose points go one at a time, from the last on: more rounds than are made at once.
    t = np.arange(400.0)
    own.append(np.column_stack([np.append(t, 400.0), np.append(t * t, -1e6)]))
    key = np.repeat(np.arange(len(own)), [len(p) for p in own])
    mixed = rng.permutation(len(key))
    k, x, y = geometry.hulls_of(key[mixed], *np.concatenate(own)[mixed].T)
    for g, p in enumerate(own):
        assert np.column_stack([x[k == g], y[k == g]]).tolist() == geometry.hull_of(p[:, 0], p[:, 1]).tolist()


def test_hulls_of_keys_over_many_batches(spark):
    """Keys that end at, and go on over, the borders of batches."""
    rows = [(None if g == 3 else g, float(i % 7 + g), float(i * i % 11)) for g in range(30) for i in range(1 + g * 3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {}
        for r in geometry.convex_hull(spark.createDataFrame(rows, "g long, x double, y double"), "g").orderBy("g", "k").collect():
            got.setdefault(r.g, []).append((r.k, r.x, r.y))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {r[0] for r in rows}
    for g, corners in got.items():
        own = np.array([r[1:] for r in rows if r[0] == g])
        assert corners == [(k, *p) for k, p in enumerate(geometry.hull_of(own[:, 0], own[:, 1]).tolist())]


def test_a_segment_on_a_border_of_tiles_has_one_row_of_them(spark):
    s = spark.createDataFrame([(1, 0, 0, 0.1, 0.5, 0.3, 0.5), (2, 0, 0, 0.5, 0.1, 0.5, 0.3), (3, 0, 0, 0.1, 0.5, 0.1, 0.75)], "path_id long, contour int, i int, x double, y double, nx double, ny double")
    got = sorted((r.path_id, r.tx, r.ty) for r in geometry.split_by_tile(s, 2).collect())
    assert got == [(1, 0, 2), (1, 1, 2), (2, 2, 0), (2, 2, 1), (3, 0, 2)]


def test_icon_totals_are_those_of_the_icons(spark):
    """A scene's totals without a row for each of its icons."""
    icons, scenes = labels.element_order(view(spark, SF, "elements")), view(spark, SF, "scenes").filter("scene_id < 200")
    by = hittest.icons_in_view(icons, scenes).groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("element_id").alias("ids"), F.min_by("element_id", "rank").alias("first_id"), F.max_by("element_id", "rank").alias("last_id"))
    assert sorted(map(tuple, hittest.icon_totals_in_view(icons, scenes).collect())) == sorted(map(tuple, by.collect()))
    plan = hittest.icon_totals_in_view(icons, scenes)._jdf.queryExecution().analyzed().toString()
    assert "row_number" not in plan


def test_stitched_tiles_take_no_call_for_each(spark):
    kids = [(s, 3, x, y, bytes([s * 16 + x * 4 + y] * 16)) for s in (1, 2, 3) for x in (0, 1) for y in (0, 1) if (s, x, y) != (2, 1, 1)] + [(3, 3, 0, 0, b"")]
    df = raster.stitch_tiles(spark.createDataFrame(kids, "source_id long, z int, x int, y int, pixels binary"), 1, 4)
    got = {r.source_id: (r.pixels and bytes(r.pixels), r.error) for r in df.collect()}
    want = b"".join(bytes([16 + x // 2 * 4 + y // 2] * 4) for y in range(4) for x in range(4))
    assert got[1] == (want, None) and got[2] == got[3] == (None, "children are missing or of another size")
    assert "FlatMapGroups" not in df._jdf.queryExecution().analyzed().toString()
