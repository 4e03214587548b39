"""Ranks and sums by ranges, collisions by rounds, movements by slices of time, styles as a table, label tables."""

import itertools
import json
import random

import pytest
from oracle import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions.rules import RuleError, compile_expression, compile_filter, shape_of
from tilewright.jobs.fixtures import view
from tilewright.operators import geometry, labels, staging, styles, telemetry
from tilewright.sources import archive
from tilewright.streaming.jobs import moved


def test_collisions_by_rounds(spark):
    c = labels.collision_candidates(labels.collision_groups(view(spark, SF, "placements").filter("scene_id < 4")))
    key = ["scene_id", "seq", "accepted"]
    want = {tuple(r) for r in labels.resolve_collisions(c).select(*key).collect()}
    got = {tuple(r) for r in labels.resolve_collisions(c, most_in_task=0).select(*key).collect()}
    assert got == want and len({r[2] for r in got}) == 2
    lone = c.filter("seq = 2")
    assert all(r.accepted for r in labels.resolve_collisions(lone, most_in_task=0).collect())


@pytest.mark.parametrize("rows", [10**9, 150])
def test_movements_by_slices(spark, rows):
    p = view(spark, SF, "points").withColumns({"ts": F.col("ts").cast("timestamp"), "lat": F.when(F.col("point_id") % 3 == 0, F.col("lat")).otherwise(F.lit(5.0)), "device": F.when(F.col("point_id") % 3 == 0, 1).otherwise(F.col("device"))})
    p = p.unionByName(p.limit(1).withColumn("lat", F.lit(None).cast("double")))
    want = set()
    for _, own in p.dropna().toPandas().groupby("device"):
        own = own.sort_values(["ts", "point_id"], ignore_index=True)
        want |= {int(own["point_id"][k]) for k in moved(own, None, 1e6, 40_000.0)[0]}
    got = [r.point_id for r in telemetry.movement_filter(p, 1e6, 40_000.0, slice_rows=rows).collect()]
    assert sorted(got) == sorted(want) and 100 < len(got) < 900
    assert telemetry.movement_filter(p.limit(0)).count() == 0


def test_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, at long, id long")
    got = {r.id: r.n for r in staging.in_order(df, ["k", "at", "id"], "n").collect()}
    assert got == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))}
    steps = df.filter("k is not null").groupBy("k", "at").agg(F.sum("id").alias("d"))
    want = steps.withColumn("n", F.sum("d").over(Window.partitionBy("k").orderBy("at")))
    assert sorted(map(tuple, staging.running_sum(steps, ["k"], "at", "d", "n").select("k", "at", "n").collect())) == sorted(map(tuple, want.select("k", "at", "n").collect()))
    assert staging.in_order(df.limit(0), ["k"], "n").count() == 0


RULES = [
    ["interpolate", ["linear"], ["zoom"], 5, 1, 9, 3], ["interpolate", ["exponential", 2], ["get", "rank"], 0, 0, 4, 15], ["step", ["get", "opt"], "s", 0.25, "m", 0.75, "l"], ["match", ["get", "rank"], [0, 1], "low", 4, "high", "mid"],
    ["case", ["==", ["get", "rank"], 0], "a", [">", ["get", "opt"], 0.5], "b", "c"], {"stops": [[5, 1], [9, 3]]}, {"property": "opt", "type": "interval", "stops": [[0, "s"], [0.25, "m"]], "default": "none"}, "{name} of {brand}", "#f00", 3, True,
    ["let", "a", ["+", ["get", "rank"], 1], ["*", ["var", "a"], 2]], ["coalesce", ["get", "opt"], ["+", ["get", "rank"], 10]], ["interpolate", ["linear"], ["get", "rank"], 0, "#000", 4, "#fff"], ["concat", ["get", "name"], "-", ["literal", "x"]], ["in", ["get", "brand"], ["literal", ["Brand#1"]]],
]


def test_shapes_mean_what_their_rules_mean(spark):
    f = view(spark, SF, "features").withColumn("opt", F.when(F.col("feature_id") % 4 != 0, F.col("level")))
    names = ["name", "rank", "level", "brand", "opt"]
    shapes = set()
    for rule in RULES:
        numbers, texts = [], []
        shape = shape_of(rule, numbers, texts)
        shapes.add(json.dumps(shape))
        g = f.withColumns({"_n": F.array(*[F.lit(x) for x in numbers]).cast("array<double>"), "_t": F.array(*[F.lit(x) for x in texts]).cast("array<string>")})
        scope = styles.scope_of(g, names, F.lit(6.5))
        plain = compile_expression(rule, styles.scope_of(g, names, F.lit(6.5)))
        scope.parameters = {"number": F.col("_n"), "string": F.col("_t")}
        cut = compile_expression(json.loads(json.dumps(shape)), scope)
        rows = g.select(F.when(~plain.failed, plain.value).cast("string").alias("a"), plain.failed.alias("af"), F.when(~cut.failed, cut.value).cast("string").alias("b"), cut.failed.alias("bf")).collect()
        assert all((r.a, r.af) == (r.b, r.bf) for r in rows), rule
    other = ["interpolate", ["linear"], ["zoom"], 3, 0.5, 12, 8]
    assert json.dumps(shape_of(other, [], [])) in shapes
    for bad in (["@", "number", 0], ["interpolate", ["linear"], ["zoom"], 5, 1, 4, 3], ["step", ["zoom"], 1, "x", 2], [], float("inf")):
        with pytest.raises(RuleError):
            shape_of(bad, [], [])


def test_styles_resolve_as_each_alone(spark):
    f = view(spark, SF, "features").withColumn("opt", F.when(F.col("feature_id") % 4 != 0, F.col("level"))).withColumn("map_id", F.col("feature_id") % 2)
    names = ["name", "rank", "level", "brand", "opt"]
    rng = random.Random(2)
    rows = []
    for style, m in itertools.product(range(12), (0, 1)):
        for k in range(3):
            paint = {"a": ["interpolate", ["linear"], ["get", "rank"], 0, rng.random(), 3, 9], "b": rng.choice(["#111", "#222", "{name}"])} if style % 3 else {"c": style}
            rule = [">", ["get", "opt"], rng.random()] if k else ["in", "brand", f"Brand#{rng.randrange(9)}"]
            rows.append((m, style, k, f"l{k}", ["line", "symbol", "fill"][k], ["road", "poi", "landcover"][k], float(style % 9), 24.0, style != 7, json.dumps(rule), json.dumps(paint)))
    rows.append((1, 90, 0, "bad", "line", "road", 0.0, 24.0, True, '["nothing"]', "{}"))
    layers = spark.createDataFrame(rows, "map_id long, style_id long, layer_order int, layer_id string, type string, source_layer string, min_zoom double, max_zoom double, visible boolean, filter string, paint string")
    got = styles.resolve_styles(f, layers, F.lit(6.0), names, ["map_id"]).collect()
    seen = {(r.map_id, r.style_id, r.feature_id, r.layer_order): (r.failed, {k: v for k, v in r.paint.items()}) for r in got}
    assert len(seen) == len(got)
    want = {}
    for (m, style), own in itertools.groupby(sorted(rows[:-1]), key=lambda r: r[:2]):
        one = [{"id": r[3], "type": r[4], "source-layer": r[5], "minzoom": r[6], "maxzoom": r[7], "visibility": "visible" if r[8] else "none", "filter": json.loads(r[9]), "paint": json.loads(r[10])} for r in own]
        for r in styles.resolve_layers(f.filter(F.col("map_id") == m), one, 6.0, names).collect():
            paint = {k: r[k] for k in ("a", "b", "c") if k in r and r[k] is not None}
            want[(m, style, r.feature_id, r.layer_order)] = (r.failed, paint)
    bad = {k: v for k, v in seen.items() if k[1] == 90}
    assert {k: v for k, v in seen.items() if k[1] != 90} == want and bad and set(map(str, bad.values())) == {"(True, {})"}


def test_filters_of_labels_by_table(spark):
    f = spark.createDataFrame([(k, f"n{k}", k / 2) for k in range(200)] + [(999, None, None)], "id long, key string, v double")
    scope = styles.scope_of(f.withColumn("geometry_type", F.lit("Point")), ["key", "v"], F.lit(1.0))
    texts = compile_expression(["match", ["get", "key"], *[x for k in range(0, 180) for x in (f"n{k}", f"arm {k % 5}")], "n3", "late", "none"], scope)
    numbers = compile_expression(["match", ["get", "v"], [k / 2 for k in range(0, 150, 3)] + [k / 2 for k in range(0, 150, 3)] + list(range(-90, 0)), 1, 0], scope)
    for r in f.withColumn("geometry_type", F.lit("Point")).select("id", texts.value.alias("t"), numbers.value.alias("n"), texts.failed.alias("f")).collect():
        assert r.t == (f"arm {r.id % 5}" if r.id < 180 else "none") and r.n == (1.0 if r.id < 150 and r.id % 3 == 0 else 0.0) and not r.f
    assert compile_filter(["==", ["get", "key"], "n1"], scope) is not None


def tiles_of(df):
    area = lambda xs, ys: sum(a * d - b * c for a, b, c, d in zip(xs, xs[1:] + xs[:1], ys, ys[1:] + ys[:1])) / 2
    out = {}
    for r in df.collect():
        assert (r.path_id, r.contour, r.tx, r.ty) not in out
        out[(r.path_id, r.contour, r.tx, r.ty)] = round(area(list(r.xs), list(r.ys)), 12)
    return out


def test_rings_by_quadrants(spark):
    """Rings as wide as the world, turned either way, a star and a sliver: as cut tile by tile."""
    import math

    star = [(0.5 + (0.45 if k % 2 else 0.12) * math.cos(k * math.pi / 7), 0.5 + (0.45 if k % 2 else 0.12) * math.sin(k * math.pi / 7)) for k in range(14)]
    rings = {1: [(0, 0), (1, 0), (1, 1), (0, 1)], 2: [(0.01, 0.02), (0.03, 0.97), (0.99, 0.9), (0.8, 0.05)], 3: star, 4: [(0.1, 0.1), (0.9, 0.1001), (0.9, 0.1002)], 5: [(0.2, 0.2), (0.21, 0.2), (0.21, 0.21)], 6: [(0.1, 0.1), (0.2, 0.2)], 7: [(-0.3, 0.25), (0.4, 0.25), (0.4, 0.75), (-0.3, 0.75)], 8: [(0.1, 0.1), (float("nan"), 0.2), (0.3, 0.3)]}
    df = spark.createDataFrame([(k, 0, i, float(x), float(y)) for k, r in rings.items() for i, (x, y) in enumerate(r)], "path_id long, contour int, i int, x double, y double")
    want = tiles_of(geometry.split_polygons_by_tile(df, 6, most=10**9))
    got = tiles_of(geometry.split_polygons_by_tile(df, 6, most=8))
    assert got == want and sum(k[0] == 1 for k in got) == 64 * 64 and {k[0] for k in got} == {1, 2, 3, 4, 5, 7}
    assert geometry.split_polygons_by_tile(df.limit(0), 6).count() == 0


def test_hulls_of_hulls(spark):
    rng = random.Random(5)
    rows = [(None if k % 50 == 0 else "a" if k % 3 else "b", rng.gauss(0, 1), float(rng.randrange(5))) for k in range(3000)] + [("one", 1.0, 2.0)] * 3 + [("line", float(k), 2.0 * k) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    got = {}
    for r in geometry.convex_hull(df, "g").orderBy("g", "k").collect():
        got.setdefault(r.g, []).append((r.x, r.y))
    import numpy as np

    for key in (None, "a", "b", "one", "line"):
        own = np.array([r[1:] for r in rows if r[0] == key])
        assert got[key] == list(map(tuple, geometry.hull_of(own[:, 0], own[:, 1]).tolist()))


def test_tile_archive(spark, tmp_path):
    rng = random.Random(6)
    rows = [(s, z, rng.randrange(1 << z), rng.randrange(1 << z), bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 900])))) for s in (1, 2, 3) for z in range(3, 9) for _ in range(20)] + [(1, 3, 0, 0, None)]
    folder = f"file://{tmp_path}"
    archive.write_tile_archive(spark.createDataFrame(rows, "source_id long, z int, x int, y int, content binary"), folder)
    whole = archive.read_tile_archive(spark, folder)
    as_rows = lambda df: sorted((r.source_id, r.z, r.x, r.y, bytes(r.content)) for r in df.collect())
    assert as_rows(whole) == sorted(rows[:-1])
    some = archive.read_tile_archive(spark, folder, source_id=(2, 2), z=(5, 7), x=(3, None))
    assert as_rows(some.filter("x <= 10")) == sorted(r for r in rows[:-1] if r[0] == 2 and 5 <= r[1] < 8 and 3 <= r[2] <= 10)
    assert 0 < some.rdd.getNumPartitions() < whole.rdd.getNumPartitions()
    assert archive.read_tile_archive(spark, folder, z=(20, None)).count() == 0 and whole.filter("z = 4 OR x = 1").count() == sum(r[1] == 4 or r[2] == 1 for r in rows[:-1])
    with pytest.raises(ValueError):
        archive.read_tile_archive(spark, folder, content=(1, 2))
    # What a lost task has left behind is not read.
    (tmp_path / "data" / "lost.tiles").write_bytes(b"x" * 99)
    assert whole.count() == len(rows) - 1
    archive.write_tile_archive(whole.limit(0), f"{folder}/none")
    assert archive.read_tile_archive(spark, f"{folder}/none").count() == 0
