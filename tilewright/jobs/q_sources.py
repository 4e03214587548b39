"""Queries of the sources: vector tiles, styles, tile services, places, telemetry and raster tiles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tilewright.jobs.fixtures import having, view
from tilewright.jobs.registry import query
from tilewright.operators import evaluate as V
from tilewright.operators import places as P
from tilewright.operators import raster as R
from tilewright.operators import styles as S
from tilewright.operators.staging import shared_folder
from tilewright.operators.tiles import pyramid_children
from tilewright.sources import archive, mvt
from tilewright.sources import tables as T

C = F.col
SH = having("shaped")
POINTS = "[[gx, gy]]"
LINE = "[[gx, gy], [gx + 100, gy + 50], [gx + 300, gy + 40]]"


def tiles(spark, sf_dir):
    """Encoded tiles of the features, in whole numbers of the tile's grid; every seventh feature's tile number is not touched."""
    at = lambda dx, dy: F.struct(((C("gx") + dx) / 4096.0).alias("x"), ((C("gy") + dy) / 4096.0).alias("y"))
    square = F.array(F.array(at(0, 0), at(400, 0), at(400, 400), at(0, 400)))
    hole = F.array(F.array(at(100, 100), at(100, 200), at(200, 200), at(200, 100)))
    parts = F.when(C("geometry_type") == "Point", F.array(F.array(at(0, 0)))).when(C("geometry_type") == "LineString", F.array(F.array(at(0, 0), at(100, 50), at(300, 40)))).otherwise(F.when(C("feature_id") % 2 == 0, F.concat(square, hole)).otherwise(square))
    f = view(spark, sf_dir, "shaped").withColumns({"feature_seq": C("feature_id"), "parts": parts, "rank": C("rank").cast("long"), "odd": C("feature_id") % 2 == 1})
    return mvt.encode_tiles(f, ["feature_id", "name", "rank", "level", "odd"])


def decoded(spark, sf_dir):
    return mvt.decode_vector_tiles(tiles(spark, sf_dir))


@query("a03_tile_blobs", SH + "SELECT source_id, z, x, y, CASE WHEN n > 20 THEN 'the tile is too large' END AS error, n > 20 AS is_null FROM (SELECT source_id, z, x, y, count(*) AS n FROM shaped GROUP BY ALL)")
def _(spark, sf_dir):
    """A kilobyte for each feature of the tile, and a limit of 20 kilobytes."""
    blobs = view(spark, sf_dir, "shaped").groupBy("source_id", "z", "x", "y").agg(F.count("*").cast("int").alias("n")).withColumn("content", F.repeat(F.lit("x"), C("n") * 1024).cast("binary")).drop("n")
    return mvt.checked_blobs(blobs, most=20 * 1024).select("source_id", "z", "x", "y", "error", C("content").isNull().alias("is_null"))


@query("a03_tile_archive", SH + """SELECT source_id, z, x, y, count(*) AS n_features, CAST(sum(feature_id) AS BIGINT) AS ids FROM shaped WHERE z BETWEEN 6 AND 11 AND x >= 10 AND source_id <= 3 GROUP BY ALL""")
def _(spark, sf_dir):
    """Encoded tiles, written to an archive and read from it by source, zoom and x."""
    folder = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    archive.write_tile_archive(tiles(spark, sf_dir), folder)
    blobs = archive.read_tile_archive(spark, folder, z=(6, 11), x=(10, None), source_id=(None, 3))
    return mvt.decode_vector_tiles(blobs).groupBy("source_id", "z", "x", "y").agg(F.count("*").alias("n_features"), F.sum(F.try_element_at("props", F.lit("feature_id"))["i"]).alias("ids"))


@query("a04_decode_vector_tiles", SH + f"""
SELECT source_id, z, x, y, source_layer, geometry_type, feature_id, name, CAST(rank AS BIGINT) AS rank, round(level, 6) AS level, feature_id % 2 = 1 AS odd,
  CASE geometry_type WHEN 'Point' THEN {POINTS} END AS points, CASE geometry_type WHEN 'LineString' THEN {LINE} END AS line,
  CASE geometry_type WHEN 'Polygon' THEN CASE WHEN feature_id % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS n_rings
FROM shaped""")
def _(spark, sf_dir):
    grid = lambda p: F.when(F.size(p) > 0, F.transform(p, lambda v: F.array(F.round(v["x"] * 4096).cast("long"), F.round(v["y"] * 4096).cast("long"))))
    p = lambda k, v: F.try_element_at("props", F.lit(k))[v]
    return decoded(spark, sf_dir).filter("error IS NULL").select(
        "source_id", "z", "x", "y", "source_layer", "geometry_type", p("feature_id", "i").alias("feature_id"), p("name", "s").alias("name"), p("rank", "i").alias("rank"), F.round(p("level", "d"), 6).alias("level"), p("odd", "b").alias("odd"),
        grid(C("points")).alias("points"), grid(F.get("lines", F.lit(0))).alias("line"), F.coalesce(F.size(F.get("polygons", F.lit(0))), F.lit(0)).alias("n_rings"),
    )


@query("a04_broken_tiles", SH + "SELECT source_id, z, x, y, 'the tile ends inside a number' AS error FROM shaped GROUP BY ALL")
def _(spark, sf_dir):
    """A tile that is cut short has one row, and no features."""
    cut = tiles(spark, sf_dir).withColumn("content", F.concat("content", F.lit(b"\x1a\x80")))
    return mvt.decode_vector_tiles(cut).select("source_id", "z", "x", "y", "error")


@query("a05_tile_stats", SH + """
SELECT source_id, z, x, y, source_layer, sum(CASE geometry_type WHEN 'Point' THEN 1 ELSE 0 END)::BIGINT AS n_points, sum(CASE geometry_type WHEN 'LineString' THEN 1 ELSE 0 END)::BIGINT AS n_lines, sum(CASE geometry_type WHEN 'LineString' THEN 3 ELSE 0 END)::BIGINT AS n_line_points,
  sum(CASE geometry_type WHEN 'Polygon' THEN 1 ELSE 0 END)::BIGINT AS n_polygons, sum(16 * CASE geometry_type WHEN 'Point' THEN 1 WHEN 'LineString' THEN 3 ELSE CASE WHEN feature_id % 2 = 0 THEN 8 ELSE 4 END END + 32 * 5 + 2 * length(source_layer))::BIGINT AS bytes
FROM shaped GROUP BY ALL""")
def _(spark, sf_dir):
    return V.tile_stats(decoded(spark, sf_dir).filter("error IS NULL"))


@query("a06_read_style", having("styles") + """
, l AS (SELECT style_id, unnest([{'k': 0, 'id': 'bg', 't': 'background', 's': NULL, 'lo': 0.0, 'hi': 24.0, 'v': true}, {'k': 1, 'id': 'roads', 't': 'line', 's': 'road', 'lo': style_id % 5, 'hi': 24.0, 'v': true}, {'k': 2, 'id': 'labels', 't': 'symbol', 's': 'poi', 'lo': 0.0, 'hi': 10 + style_id % 4, 'v': style_id % 3 <> 0},
  {'k': 3, 'id': 'heat', 't': 'heatmap', 's': NULL, 'lo': 0.0, 'hi': 24.0, 'v': true}, {'k': 4, 'id': 'odd', 't': CASE WHEN style_id % 2 = 0 THEN 'strange' ELSE 'circle' END, 's': NULL, 'lo': 0.0, 'hi': 24.0, 'v': true}]) AS r FROM styles)
SELECT style_id, CAST(r.k AS INT) AS layer_order, r.id AS layer_id, r.t AS type, r.s AS source_layer, CAST(r.lo AS DOUBLE) AS min_zoom, CAST(r.hi AS DOUBLE) AS max_zoom, r.v AS visible, CASE WHEN r.k = 1 THEN '["has","opt"]' END AS filter FROM l""")
def _(spark, sf_dir):
    return T.read_style(view(spark, sf_dir, "styles"), keep=("style_id",)).select("style_id", "layer_order", "layer_id", "type", "source_layer", "min_zoom", "max_zoom", "visible", "filter")


@query("a07_tile_service", having("services") + """
, e AS (SELECT service_id, CASE WHEN service_id % 7 = 0 THEN 'tiles are not square' WHEN service_id % 11 = 0 THEN 'there is no level' END AS error FROM services)
SELECT service_id, error, CASE WHEN error IS NULL THEN concat('t/', service_id) END AS tile_url, CASE WHEN error IS NULL THEN 's' END AS style_url, CASE WHEN error IS NULL THEN 512 END AS tile_size, CASE WHEN error IS NULL THEN CAST(service_id % 3 AS INT) END AS min_zoom,
  CASE WHEN error IS NULL THEN CAST(3 + service_id % 4 AS INT) END AS max_zoom, CASE WHEN error IS NULL THEN CASE WHEN service_id % 2 = 0 THEN 'Someone' ELSE 'Contributors' END END AS attribution FROM e""")
def _(spark, sf_dir):
    return T.read_tile_service_metadata(view(spark, sf_dir, "services"))


@query("a02_indexed_places", having("places") + "SELECT row_number() OVER (ORDER BY entity_type, name, place_id) - 1 AS item, count(*) OVER () AS n_items, name, address, round(lat, 6) AS lat, round(lon, 6) AS lon FROM places")
def _(spark, sf_dir):
    p = T.indexed_places(view(spark, sf_dir, "places"), ["entity_type", "name", "place_id"])
    return p.select("item", "n_items", "name", "address", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("a02_written_places", having("places") + "SELECT row_number() OVER (ORDER BY name, place_id) - 1 AS item, count(*) OVER () AS n_items, name, address, round(lat, 6) AS lat, round(lon, 6) AS lon FROM places WHERE name <> ''")
def _(spark, sf_dir):
    """Valid places, numbered, written as files and read again."""
    folder = f"{shared_folder(spark)}/places-{uuid.uuid4().hex}"
    T.write_places(P.valid_places(view(spark, sf_dir, "places")), folder, ["name", "place_id"])
    return spark.read.parquet(folder).select("item", "n_items", "name", "address", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("a08_telemetry_files", "SELECT event_id FROM events WHERE event_id % 5 < 3 AND (event_id % 2048) & 72 <> 0")
def _(spark, sf_dir):
    """Events as JSON lines in files, filtered as they are read."""
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    level = F.element_at(F.array(*[F.lit(v) for v in T.LEVELS]), (C("event_id") % 5 + 1).cast("int"))
    view(spark, sf_dir, "events").select("event_id", level.alias("level"), (C("event_id") % 2048).alias("keywords")).write.json(folder)
    return T.read_telemetry(spark, folder, "event_id long, level string, keywords long", "warning", T.KEYWORDS["tiles"] | T.KEYWORDS["errors"]).select("event_id")


@query("a08_read_telemetry", "SELECT event_id FROM events WHERE event_id % 5 < 3 AND (event_id % 2048) & 72 <> 0")
def _(spark, sf_dir):
    level = F.element_at(F.array(*[F.lit(v) for v in T.LEVELS]), (C("event_id") % 5 + 1).cast("int"))
    e = view(spark, sf_dir, "events").select("event_id", level.alias("level"), (C("event_id") % 2048).alias("keywords"))
    return T.at_level(e, "warning", T.KEYWORDS["tiles"] | T.KEYWORDS["errors"]).select("event_id")


@query("j13_region_bounds", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'ZZ' ELSE concat('N', c_nationkey) END AS k FROM customer)
SELECT c_custkey, coalesce(n_nationkey * 5.0 - 100, -180) AS west, coalesce(n_nationkey - 20.0, -70) AS south, coalesce(n_nationkey * 5.0 - 90, 180) AS east, coalesce(n_nationkey + 5.0, 80) AS north FROM c LEFT JOIN nation ON k = concat('N', n_nationkey)""")
def _(spark, sf_dir):
    key = C("n_nationkey").cast("double")
    regions = view(spark, sf_dir, "nation").select(F.concat(F.lit("N"), C("n_nationkey")).alias("code"), (key * 5 - 100).alias("west"), (key - 20).alias("south"), (key * 5 - 90).alias("east"), (key + 5).alias("north"))
    rows = view(spark, sf_dir, "customer").select("c_custkey", F.when(C("c_custkey") % 7 == 0, "zz").otherwise(F.concat(F.lit(" n"), C("c_nationkey"))).alias("region"))
    return P.region_bounds(rows, regions).drop("region")


@query("g06_style_compatibility", having("styles") + """
SELECT style_id, kind, construct, CAST(n AS BIGINT) AS n FROM (
  SELECT style_id, 'type' AS kind, 'heatmap' AS construct, 1 AS n FROM styles UNION ALL SELECT style_id, 'type', CASE WHEN style_id % 2 = 0 THEN 'other' ELSE 'circle' END, 1 FROM styles UNION ALL SELECT style_id, 'layout', 'other', 1 FROM styles
  UNION ALL SELECT style_id, 'paint', 'background-pattern', 1 FROM styles UNION ALL SELECT style_id, 'ignored layout', 'symbol-avoid-edges', 1 FROM styles)""")
def _(spark, sf_dir):
    return S.style_compatibility(T.read_style(view(spark, sf_dir, "styles"), keep=("style_id",)), ("style_id",))


@query("g07_zoom_breakpoints", having("styles") + """
, s AS (SELECT style_id, CAST(concat('5.', 1 + style_id % 8) AS DOUBLE) AS s FROM styles), z AS (SELECT style_id, unnest([5.0::DOUBLE, s - 0.000001, s, s + 0.000001, 5.999999::DOUBLE]) AS zoom FROM s)
SELECT style_id, CAST(row_number() OVER (PARTITION BY style_id ORDER BY zoom) AS INT) AS rank, round(zoom, 7) AS zoom FROM z""")
def _(spark, sf_dir):
    return S.zoom_breakpoints(T.read_style(view(spark, sf_dir, "styles"), keep=("style_id",)), 5, "style_id").withColumn("zoom", F.round("zoom", 7))


def pixels(seed, n):
    """n pixels that depend on a tile's number: one of 256 buffers."""
    return F.get(F.array(*[F.lit(bytes((s * 7 + k * 31) % 256 for k in range(4 * n))) for s in range(256)]), F.pmod(seed, F.lit(256)).cast("int"))


def raster_tiles(spark, sf_dir, n=16):
    return view(spark, sf_dir, "tile_cache").select("source_id", "z", "x", "y", pixels(C("x") + C("y") * 3 + C("z"), n).alias("pixels"))


BYTE = "((({0}) * 7 + ({1}) * 31) % 256)"


@query("d01_composite_tiles", having("tile_cache") + f""", s AS (SELECT source_id, z, x, y, x + y * 3 + z AS a, x * 5 + z AS b FROM tile_cache),
p AS (SELECT *, k, {BYTE.format('b', 'k')} AS o, {BYTE.format('a', 'k')} AS u, {BYTE.format('b', 'k // 4 * 4 + 3')} AS al FROM s, unnest(range(64)) AS t(k))
SELECT source_id, z, x, y, CAST(sum((k + 1) * CASE WHEN k % 4 = 3 THEN 255 ELSE (o * al + u * (255 - al) + 127) // 255 END) AS BIGINT) AS total, NULL::VARCHAR AS error FROM p GROUP BY source_id, z, x, y""")
def _(spark, sf_dir):
    low = raster_tiles(spark, sf_dir)
    high = view(spark, sf_dir, "tile_cache").select("source_id", "z", "x", "y", pixels(C("x") * 5 + C("z"), 16).alias("pixels"))
    return weighed(R.composite_tiles(low, high))


def weighed(df, *more):
    """The sum of a buffer's bytes, each times its place."""

    @F.pandas_udf("long")
    def total(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            sizes = s.str.len()
            out = pd.Series([None] * len(s), index=s.index, dtype="Int64")
            # Buffers of one length at once.
            for n, rows in s[s.notna()].groupby(sizes):
                out[rows.index] = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), int(n)) @ np.arange(1, int(n) + 1)
            yield out

    return df.select("source_id", "z", "x", "y", *more, total("pixels").alias("total"), "error")


@query("d02_stitch_tiles", having("tile_cache") + f""", c AS (SELECT DISTINCT source_id, 6 AS z, CAST(x * CAST(pow(2, 6 - z) AS INT) + dx AS INT) AS x, CAST(y * CAST(pow(2, 6 - z) AS INT) + dy AS INT) AS y FROM tile_cache, unnest(range(CAST(pow(2, 6 - z) AS BIGINT))) AS a(dx), unnest(range(CAST(pow(2, 6 - z) AS BIGINT))) AS b(dy) WHERE z = 5),
p AS (SELECT source_id, x // 2 AS px, y // 2 AS py, (y % 2 * 2 + k // 8) * 16 + x % 2 * 8 + k % 8 + 1 AS place, {BYTE.format('x + y', 'k')} AS v FROM c, unnest(range(16)) AS t(k))
SELECT source_id, 5 AS z, CAST(px AS INT) AS x, CAST(py AS INT) AS y, CAST(sum(place * v) AS BIGINT) AS total, NULL::VARCHAR AS error FROM p GROUP BY ALL""")
def _(spark, sf_dir):
    """Children of 2 x 2 pixels, four to a tile."""
    t = view(spark, sf_dir, "tile_cache").filter("z = 5").select("source_id", "z", "x", "y")
    kids = pyramid_children(t.select("z", "x", "y").distinct(), 6).join(t, ["z", "x", "y"]).select("source_id", C("child_z").alias("z"), C("child_x").cast("int").alias("x"), C("child_y").cast("int").alias("y"))
    return weighed(R.stitch_tiles(kids.withColumn("pixels", pixels(C("x") + C("y"), 4)), 1, 4))


@query("d03_crop_overzoom", having("tile_cache") + f""", t AS (SELECT source_id, z, x, y FROM tile_cache WHERE z = 5), a AS (SELECT t.*, max(c.z) AS pz FROM t JOIN tile_cache c ON c.source_id = t.source_id AND c.z < 5 AND c.x = t.x >> (5 - c.z) AND c.y = t.y >> (5 - c.z) GROUP BY ALL),
g AS (SELECT *, x >> (5 - pz) AS ax, y >> (5 - pz) AS ay, 8 >> (5 - pz) AS w, (x % (1 << (5 - pz))) * (8 >> (5 - pz)) AS ox, (y % (1 << (5 - pz))) * (8 >> (5 - pz)) AS oy FROM a),
h AS (SELECT *, greatest(0, ox - 1) AS l, greatest(0, oy - 1) AS u, least(8, ox + w + 1) AS r, least(8, oy + w + 1) AS d FROM g),
p AS (SELECT h.*, ((yy - u) * (r - l) + xx - l) * 4 + b + 1 AS place, {BYTE.format('ax + ay * 3 + pz', '(yy * 8 + xx) * 4 + b')} AS v FROM h, unnest(range(8)) AS k1(xx), unnest(range(8)) AS k2(yy), unnest(range(4)) AS k3(b) WHERE xx >= l AND xx < r AND yy >= u AND yy < d)
SELECT source_id, z, x, y, CAST(pz AS INT) AS parent_z, CAST(r - l AS INT) AS width, CAST(d - u AS INT) AS height, round(w / CAST(r - l AS DOUBLE), 6) AS scale_x, round((oy - u) / CAST(d - u AS DOUBLE), 6) AS shift_y, CAST(sum(place * v) AS BIGINT) AS total, NULL::VARCHAR AS error
FROM p GROUP BY source_id, z, x, y, pz, r, l, d, u, w, oy""")
def _(spark, sf_dir):
    """Tiles of 8 x 8 pixels of the zooms above 5."""
    up = raster_tiles(spark, sf_dir, 64).withColumns({"width": F.lit(8), "height": F.lit(8)})
    out = R.crop_overzoom(up.filter("z < 5"), view(spark, sf_dir, "tile_cache").filter("z = 5"))
    return weighed(out.withColumns({"scale_x": F.round("scale_x", 6), "shift_y": F.round("shift_y", 6)}), "parent_z", "width", "height", "scale_x", "shift_y")
