"""Queries of the projection functions, tile enumeration and the cache jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import mercator as M
from tilewright.jobs.fixtures import having, view
from tilewright.jobs.registry import query
from tilewright.operators import cache as K
from tilewright.operators import tiles as T
from tilewright.operators.staging import written

C = F.col
#: Projection in the oracle's words, of a longitude or a latitude.
NL = "(CASE WHEN isfinite({0}) THEN CASE WHEN (({0} + 180) - 360 * floor(({0} + 180) / 360)) - 180 = -180 AND {0} > 0 THEN 180.0 ELSE (({0} + 180) - 360 * floor(({0} + 180) / 360)) - 180 END ELSE 0.0 END)"
WX = "((" + NL + " + 180) / 360)"
WY = "((1 - ln(tan(greatest(-85.05112878, least(85.05112878, {0})) * pi() / 180) + 1 / cos(greatest(-85.05112878, least(85.05112878, {0})) * pi() / 180)) / pi()) / 2)"
LAT = "greatest(-85.05112878, least(85.05112878, atan((exp(pi() * (1 - 2 * ({0}))) - exp(-pi() * (1 - 2 * ({0})))) / 2) * 180 / pi()))"
Z5X, Z5Y = f"CAST(least(31, floor({WX.format('lon')} * 32)) AS INT)", f"CAST(greatest(0, least(31, floor({WY.format('lat')} * 32))) AS INT)"


def wx(c: str) -> str:
    return WX.format(c)


def wy(c: str) -> str:
    return WY.format(c)


def rounded(*columns: str, places: int = 6) -> list:
    return [F.round(C(c), places).alias(c) for c in columns]


def tiled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the zoom, x and y of a tile; the zoom depends on the point."""
    p = view(spark, sf_dir, "points").withColumn("z", (C("point_id") % 12).cast("int"))
    return p.withColumn("x", M.tile_x(C("lon"), C("z"))).withColumn("y", M.tile_y(C("lat"), C("z")))


TP = having("points") + f", n AS (SELECT *, CAST(point_id % 12 AS INT) AS z, CAST(pow(2, point_id % 12) AS BIGINT) AS n FROM points), tp AS (SELECT *, CAST(least(n - 1, floor({wx('lon')} * n)) AS INT) AS x, CAST(greatest(0, least(n - 1, floor({wy('lat')} * n))) AS INT) AS y FROM n)\n"


@query("b01_normalize_longitude", having("points") + f"SELECT point_id, round({NL.format('(lon * 7)')}, 6) AS lon7 FROM points")
def _(spark, sf_dir):
    return view(spark, sf_dir, "points").select("point_id", F.round(M.normalize_longitude(C("lon") * 7), 6).alias("lon7"))


@query("b02_world_xy", having("points") + f"SELECT point_id, round({wx('lon')}, 9) AS wx, round({wy('lat')}, 9) AS wy FROM points")
def _(spark, sf_dir):
    return view(spark, sf_dir, "points").select("point_id", F.round(M.lon_to_world_x(C("lon")), 9).alias("wx"), F.round(M.lat_to_world_y(C("lat")), 9).alias("wy"))


@query("b03_world_to_lon_lat", having("points") + f"SELECT point_id, round((value / 7 - floor(value / 7)) * 360 - 180, 6) AS lon, round({LAT.format('greatest(0, least(1, value / 500))')}, 6) AS lat FROM points")
def _(spark, sf_dir):
    return view(spark, sf_dir, "points").select("point_id", F.round(M.world_x_to_lon(C("value") / 7), 6).alias("lon"), F.round(M.world_y_to_lat(C("value") / 500), 6).alias("lat"))


@query("b04_points_by_tile", having("points") + f"SELECT {Z5X} AS x, {Z5Y} AS y, count(*) AS n, round(sum(value), 4) AS total FROM points GROUP BY ALL")
def _(spark, sf_dir):
    z = F.lit(5)
    return view(spark, sf_dir, "points").groupBy(M.tile_x(C("lon"), z).alias("x"), M.tile_y(C("lat"), z).alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("b05_tile_bounds", TP + f"SELECT point_id, round(x / n * 360 - 180, 6) AS west, round((x + 1) / n * 360 - 180, 6) AS east, round({LAT.format('(y + 1) / n')}, 6) AS south, round({LAT.format('y / n')}, 6) AS north FROM tp")
def _(spark, sf_dir):
    b = M.tile_bounds(C("z"), C("x"), C("y"))
    return tiled_points(spark, sf_dir).select("point_id", *[F.round(b[k], 6).alias(k) for k in ("west", "east", "south", "north")])


@query("b06_tile_bbox_3857", TP + "SELECT point_id, round(x * (2 * 20037508.342789244 / n) - 20037508.342789244, 3) AS west, round(20037508.342789244 - (y + 1) * (2 * 20037508.342789244 / n), 3) AS south, round((x + 1) * (2 * 20037508.342789244 / n) - 20037508.342789244, 3) AS east, round(20037508.342789244 - y * (2 * 20037508.342789244 / n), 3) AS north FROM tp")
def _(spark, sf_dir):
    b = M.tile_bbox_3857(C("z"), C("x"), C("y"))
    return tiled_points(spark, sf_dir).select("point_id", *[F.round(b[k], 3).alias(k) for k in ("west", "south", "east", "north")])


@query("b07_tile_intersects_bounds", TP + f"SELECT point_id, x / n * 360 - 180 < 31 AND (x + 1) / n * 360 - 180 > -17 AND {LAT.format('(y + 1) / n')} < 52 AND {LAT.format('y / n')} > -11 AS hit FROM tp")
def _(spark, sf_dir):
    return tiled_points(spark, sf_dir).select("point_id", M.tile_intersects(C("z"), C("x"), C("y"), F.lit(-17.0), F.lit(-11.0), F.lit(31.0), F.lit(52.0)).alias("hit"))


QK = "coalesce(list_aggregate(list_transform(range(z, 0, -1), lambda i: CAST(((x >> CAST(i - 1 AS INT)) & 1) + 2 * ((y >> CAST(i - 1 AS INT)) & 1) AS VARCHAR)), 'string_agg', ''), '')"


@query("b08_quadkey", TP + f"SELECT point_id, {QK} AS quadkey FROM tp")
def _(spark, sf_dir):
    return tiled_points(spark, sf_dir).select("point_id", M.quadkey(C("z"), C("x"), C("y")).alias("quadkey"))


@query("b09_tms_y", TP + "SELECT point_id, CAST(n - 1 - y AS INT) AS tms_y FROM tp")
def _(spark, sf_dir):
    return tiled_points(spark, sf_dir).select("point_id", M.tms_y(C("z"), C("y")).alias("tms_y"))


SUB = "(['a','b','c','d'])[CAST(xor(xor((CAST(x AS BIGINT) * 73856093) & 4294967295, (CAST(y AS BIGINT) * 19349663) & 4294967295), (CAST(z AS BIGINT) * 83492791) & 4294967295) % 4 AS INT) + 1]"


@query("b10_subdomain", TP + f"SELECT point_id, {SUB} AS subdomain FROM tp")
def _(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in "abcd"])
    return tiled_points(spark, sf_dir).select("point_id", M.subdomain(C("z"), C("x"), C("y"), names).alias("subdomain"))


@query("b11_expand_tile_url", TP + f"SELECT point_id, concat('https://', {SUB}, '.example/', z, '/', x, '/', CAST(n - 1 - y AS INT), '/', {QK}, '?l=', z, '&c=', x) AS url FROM tp")
def _(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in "abcd"])
    url = M.expand_tile_url(F.lit("https://{Subdomain}.example/{Z}/{x}/{y}/{QuadKey}?l=[level]&c=[Column]"), C("z"), C("x"), C("y"), row=M.tms_y(C("z"), C("y")), names=names)
    return tiled_points(spark, sf_dir).select("point_id", url.alias("url"))


@query("b12_valid_template", "SELECT page_id, regexp_matches(u, '^https?://[^/?#\\s]+', 'i') AND NOT regexp_matches(u, '[{}]') AS ok FROM (SELECT page_id, regexp_replace(concat(url, CASE page_id % 3 WHEN 0 THEN '/{z}/{x}' WHEN 1 THEN '/{Y}/[row]' ELSE '/{bad}' END), '\\{(z|x|y)\\}|\\[row\\]', '0', 'gi') AS u FROM pages)")
def _(spark, sf_dir):
    u = F.concat(C("url"), F.when(C("page_id") % 3 == 0, "/{z}/{x}").when(C("page_id") % 3 == 1, "/{Y}/[row]").otherwise("/{bad}"))
    return view(spark, sf_dir, "pages").select("page_id", M.is_valid_tile_template(u).alias("ok"))


SIZES = "(CASE scene_id % 4 WHEN 0 THEN 256 WHEN 1 THEN 512 WHEN 2 THEN 128 ELSE 1 END)"


@query("b13_source_zoom", having("scenes") + f"SELECT scene_id, CAST(greatest(0, least(floor(zoom + log2(256.0 / {SIZES})), floor(zoom + 3))) AS INT) AS source_zoom FROM scenes")
def _(spark, sf_dir):
    size = F.when(C("scene_id") % 4 == 0, 256).when(C("scene_id") % 4 == 1, 512).when(C("scene_id") % 4 == 2, 128).otherwise(1)
    return view(spark, sf_dir, "scenes").select("scene_id", M.source_zoom(C("zoom"), size).alias("source_zoom"))


@query("b14_clamp_source_zoom", having("scenes") + "SELECT scene_id, CASE WHEN floor(zoom) >= 4 THEN CAST(least(floor(zoom), 7) AS INT) END AS source_zoom FROM scenes")
def _(spark, sf_dir):
    return view(spark, sf_dir, "scenes").select("scene_id", M.clamp_source_zoom(F.floor("zoom").cast("int"), F.lit(4), F.lit(7)).alias("source_zoom"))


@query("b15_normalize_camera", having("points") + """SELECT point_id, round(h - 360 * floor(h / 360), 6) AS heading, round(greatest(0, least(60, value - 200)), 6) AS pitch, round(greatest(0, least(22, value / 10)), 6) AS zoom,
    round(t - 360 * floor(t / 360) - 180, 6) AS delta FROM (SELECT *, (h + 540) - 360 * floor(h / 360) AS t0, 3 * value - 360 * floor(3 * value / 360) - (h - 360 * floor(h / 360)) + 540 AS t FROM (SELECT *, value * 5 - 1000 AS h FROM points))""")
def _(spark, sf_dir):
    h = C("value") * 5 - 1000
    cols = {"heading": M.normalize_heading(h), "pitch": M.normalize_pitch(C("value") - 200), "zoom": M.normalize_zoom(C("value") / 10), "delta": M.shortest_heading_delta(h, C("value") * 3)}
    return view(spark, sf_dir, "points").select("point_id", *[F.round(v, 6).alias(k) for k, v in cols.items()])


def camera(c: str) -> str:
    return f"{c}.lon, {c}.lat"


WSIZE = "(256 * pow(2, zoom))"
PROJECT = f"""p AS (SELECT scene_id, vw, vh, heading, pitch, ({wx('(lon + 3)')} - {wx('lon')} - round_even({wx('(lon + 3)')} - {wx('lon')}, 0)) * {WSIZE} AS dx, ({wy('(lat * 0.9)')} - {wy('lat')}) * {WSIZE} AS dy FROM scenes),
r AS (SELECT *, dx * cos(heading * pi() / 180) + dy * sin(heading * pi() / 180) AS rx, dy * cos(heading * pi() / 180) - dx * sin(heading * pi() / 180) AS ry, greatest(1, vh * 0.5 / tan(20 * pi() / 180)) AS far FROM p),
s AS (SELECT *, CASE WHEN pitch = 0 THEN 1 ELSE far / greatest(1, far - ry * sin(pitch * pi() / 180)) END AS k FROM r)
"""


@query("b16_project_to_viewport", having("scenes") + ", " + PROJECT + "SELECT scene_id, round(rx * k + vw / 2, 3) AS px, round(ry * CASE WHEN pitch = 0 THEN 1 ELSE cos(pitch * pi() / 180) END * k + vh / 2, 3) AS py FROM s")
def _(spark, sf_dir):
    at = M.project_to_viewport(C("lon") + 3, C("lat") * 0.9, C("lon"), C("lat"), C("zoom"), C("vw"), C("vh"), C("heading"), C("pitch"))
    return view(spark, sf_dir, "scenes").withColumn("at", at).select("scene_id", F.round("at.x", 3).alias("px"), F.round("at.y", 3).alias("py"))


UNPROJECT = f"""u AS (SELECT *, CAST((scene_id * 37) % 1100 AS DOUBLE) AS px, CAST((scene_id * 53) % 800 AS DOUBLE) AS py, greatest(1, vh * 0.5 / tan(20 * pi() / 180)) AS far, pitch * pi() / 180 AS a, -heading * pi() / 180 AS h FROM scenes),
v AS (SELECT *, CASE WHEN a = 0 THEN py - vh / 2 ELSE (py - vh / 2) * far / (far * cos(a) + (py - vh / 2) * sin(a)) END AS fy FROM u),
w AS (SELECT *, CASE WHEN a = 0 THEN px - vw / 2 ELSE (px - vw / 2) * (far - fy * sin(a)) / far END AS fx FROM v),
q AS (SELECT *, {wx('lon')} + (fx * cos(h) + fy * sin(h)) / {WSIZE} AS qx, {wy('lat')} + (fy * cos(h) - fx * sin(h)) / {WSIZE} AS qy FROM w)
"""


@query("b17_viewport_to_location", having("scenes") + ", " + UNPROJECT + f"SELECT scene_id, CASE WHEN px <= vw AND py <= vh THEN round((qx - floor(qx)) * 360 - 180, 5) END AS lon, CASE WHEN px <= vw AND py <= vh THEN round({LAT.format('greatest(0, least(1, qy))')}, 5) END AS lat FROM q")
def _(spark, sf_dir):
    s = view(spark, sf_dir, "scenes").withColumn("px", ((C("scene_id") * 37) % 1100).cast("double")).withColumn("py", ((C("scene_id") * 53) % 800).cast("double"))
    at = M.viewport_to_location(C("px"), C("py"), C("lon"), C("lat"), C("zoom"), C("vw"), C("vh"), C("heading"), C("pitch"))
    return s.withColumn("at", at).select("scene_id", F.round("at.lon", 5).alias("lon"), F.round("at.lat", 5).alias("lat"))


HAV = "2 * 6371000 * asin(sqrt(greatest(0, least(1, pow(sin(({2} - {0}) * pi() / 360), 2) + cos({0} * pi() / 180) * cos({2} * pi() / 180) * pow(sin(({3} - {1}) * pi() / 360), 2)))))"


@query("b20_haversine", having("points") + f"SELECT point_id, round({HAV.format('lat', 'lon', '(lat * 0.5)', '(lon + 10)')}, 2) AS metres FROM points")
def _(spark, sf_dir):
    return view(spark, sf_dir, "points").select("point_id", F.round(M.haversine_m(C("lat"), C("lon"), C("lat") * 0.5, C("lon") + 10), 2).alias("metres"))


@query("b21_meters_to_tile_units", TP + f"SELECT point_id, round(n / (40075016.68557849 * cos({LAT.format('y / n')} * pi() / 180)), 9) AS units FROM tp")
def _(spark, sf_dir):
    return tiled_points(spark, sf_dir).select("point_id", F.round(M.meters_to_tile_units(C("z"), C("y")), 9).alias("units"))


@query("b22_rectangle_visible", having("placements") + 'SELECT scene_id, seq, "left" - 40 < 900 AND "left" - 40 + width > 0 AND top - 60 < 600 AND top - 60 + height > 0 AS visible FROM placements')
def _(spark, sf_dir):
    p = view(spark, sf_dir, "placements")
    return p.select("scene_id", "seq", M.rectangle_visible(C("left") - 40, C("top") - 60, C("width"), C("height"), F.lit(900.0), F.lit(600.0)).alias("visible"))


# The four corners of a scene's viewport, turned back to the ground plane: lx, hx, ly and hy about the camera.
BOXES = """
f AS (
  SELECT *, CAST(floor(zoom) AS INT) AS z, 256 * pow(2, zoom - floor(zoom)) AS size, ((360 - heading) % 360) * pi() / 180 AS turn, pitch * pi() / 180 AS lean,
    greatest(1, (vh + 0) * 0.5 / tan(20 * pi() / 180)) AS far, vw / 2 + {m} AS hw, -(vh / 2 + {m}) AS top0, vh / 2 + {m} AS bot0
  FROM scenes
), f1 AS (
  SELECT *, CASE WHEN {m} > 0 AND sin(lean) > 0 THEN greatest(top0, -0.75 * far * cos(lean) / sin(lean)) ELSE top0 END AS yt FROM f
), f2 AS (
  SELECT *, CASE WHEN lean = 0 THEN yt ELSE yt * far / (far * cos(lean) + yt * sin(lean)) END AS ft, CASE WHEN lean = 0 THEN bot0 ELSE bot0 * far / (far * cos(lean) + bot0 * sin(lean)) END AS fb FROM f1
), f3 AS (
  SELECT *, CASE WHEN lean = 0 THEN hw ELSE hw * (far - ft * sin(lean)) / far END AS st, CASE WHEN lean = 0 THEN hw ELSE hw * (far - fb * sin(lean)) / far END AS sb FROM f2
), bx AS (
  SELECT *,
    least(-st * cos(turn) + ft * sin(turn), st * cos(turn) + ft * sin(turn), -sb * cos(turn) + fb * sin(turn), sb * cos(turn) + fb * sin(turn)) AS lx,
    greatest(-st * cos(turn) + ft * sin(turn), st * cos(turn) + ft * sin(turn), -sb * cos(turn) + fb * sin(turn), sb * cos(turn) + fb * sin(turn)) AS hx,
    least(ft * cos(turn) + st * sin(turn), ft * cos(turn) - st * sin(turn), fb * cos(turn) + sb * sin(turn), fb * cos(turn) - sb * sin(turn)) AS ly,
    greatest(ft * cos(turn) + st * sin(turn), ft * cos(turn) - st * sin(turn), fb * cos(turn) + sb * sin(turn), fb * cos(turn) - sb * sin(turn)) AS hy
  FROM f3
)"""


def boxes(margin: float = 0) -> str:
    return BOXES.format(m=margin)


GRID = f"""
g AS (SELECT *, {wx('lon')} * size * pow(2, z) AS cx, greatest(0, least(size * pow(2, z), {wy('lat')} * size * pow(2, z))) AS cy FROM bx),
h AS (
  SELECT *, CAST(floor((cx + lx) / size) AS INT) AS x0, CAST(floor((cx + hx - 1e-7) / size) AS INT) AS x1,
    greatest(0, CAST(floor((cy + ly) / size) AS INT)) AS y0, least(CAST(pow(2, z) AS INT) - 1, CAST(floor((cy + hy - 1e-7) / size) AS INT)) AS y1
  FROM g
)"""
TILES = having("scenes", "layers", "tile_cache") + "," + boxes() + "," + GRID + f""",
vt AS (
  SELECT scene_id, z, CAST(((wxi % CAST(pow(2, z) AS BIGINT)) + CAST(pow(2, z) AS BIGINT)) % CAST(pow(2, z) AS BIGINT) AS INT) AS x, CAST(yi AS INT) AS y, CAST(wxi AS INT) AS world_x,
    CAST((yi - y0) * (x1 - x0 + 1) + wxi - x0 AS INT) AS tile_index, wxi * size - cx + vw / 2 AS "left", yi * size - cy + vh / 2 AS top, size, vw, vh
  FROM h, unnest(range(y0, y1 + 1)) AS a(yi), unnest(range(x0, x1 + 1)) AS b(wxi)
), rq AS (
  SELECT scene_id, z, x, y, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY d2, tile_index) AS INT) AS priority FROM (
    SELECT *, row_number() OVER (PARTITION BY scene_id, z, x, y ORDER BY d2, tile_index) AS r FROM (
      SELECT *, ("left" + size / 2 - vw / 2) * ("left" + size / 2 - vw / 2) + (top + size / 2 - vh / 2) * (top + size / 2 - vh / 2) AS d2 FROM vt)) WHERE r = 1
), ac AS (
  SELECT scene_id, source_id FROM scenes JOIN layers USING (map_id) WHERE is_visible AND opacity > 0 AND zoom >= min_zoom AND zoom < max_zoom
), rt AS (
  SELECT rq.scene_id, l.source_id, z, x, y, priority FROM rq JOIN ac USING (scene_id) JOIN layers l USING (source_id)
  WHERE x / pow(2, z) * 360 - 180 < east AND (x + 1) / pow(2, z) * 360 - 180 > west AND {LAT.format('(y + 1) / pow(2, z)')} < north AND {LAT.format('y / pow(2, z)')} > south
)
"""


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.visible_tiles(view(spark, sf_dir, "scenes"))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.active_layers(view(spark, sf_dir, "scenes"), view(spark, sf_dir, "layers"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.request_tiles(T.required_tiles(shown(spark, sf_dir)), active(spark, sf_dir), view(spark, sf_dir, "layers"))


@query("c01_visible_tiles", TILES + 'SELECT scene_id, z, x, y, world_x, tile_index, round("left", 2) AS "left", round(top, 2) AS top FROM vt')
def _(spark, sf_dir):
    return shown(spark, sf_dir).select("scene_id", "z", "x", "y", "world_x", "tile_index", *rounded("left", "top", places=2))


@query("c01_visible_tiles_margin", having("scenes") + "," + boxes(128) + """, pl AS (SELECT scene_id, plain.lx AS plx, plain.hx AS phx, plain.ly AS ply, plain.hy AS phy FROM (WITH""" + boxes().replace("FROM scenes", "FROM scenes") + """ SELECT scene_id, lx, hx, ly, hy FROM bx) AS plain),
bm AS (SELECT bx.* EXCLUDE (lx, hx, ly, hy), least(plx, greatest(plx - 512, lx)) AS lx, greatest(phx, least(phx + 512, hx)) AS hx, least(ply, greatest(ply - 512, ly)) AS ly, greatest(phy, least(phy + 512, hy)) AS hy FROM bx JOIN pl USING (scene_id)),
""" + GRID.replace("FROM bx)", "FROM bm)") + """
SELECT scene_id, z, (x1 - x0 + 1) * (y1 - y0 + 1) AS n, x0, x1, y0, y1 FROM h WHERE x0 <= x1 AND y0 <= y1""")
def _(spark, sf_dir):
    """With a margin that reaches beyond the viewport."""
    return T.visible_tiles(view(spark, sf_dir, "scenes"), margin=128.0).groupBy("scene_id", "z").agg(F.count("*").alias("n"), F.min("world_x").alias("x0"), F.max("world_x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("c02_required_tiles", TILES + "SELECT * FROM rq")
def _(spark, sf_dir):
    return T.required_tiles(shown(spark, sf_dir))


@query("c03_active_layers", TILES + "SELECT * FROM ac")
def _(spark, sf_dir):
    return active(spark, sf_dir)


@query("c04_request_tiles", TILES + "SELECT * FROM rt")
def _(spark, sf_dir):
    return requests(spark, sf_dir)


LOOK = TILES + """, lk AS (SELECT rt.*, CASE WHEN c.status = 'F' THEN 'hit' WHEN c.status = 'O' THEN 'pending' ELSE 'missing' END AS found FROM rt LEFT JOIN tile_cache c USING (source_id, z, x, y))
"""


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = view(spark, sf_dir, "tile_cache")
    return c.filter("status = 'F'"), c.filter("status = 'O'")


@query("c05_cache_lookup", LOOK + "SELECT scene_id, count(*) AS n_required, count(*) FILTER (found = 'hit') AS n_hit, count(*) FILTER (found = 'pending') AS n_pending, count(*) FILTER (found = 'missing') AS n_missing FROM lk GROUP BY scene_id")
def _(spark, sf_dir):
    return K.lookup_counts(K.lookup(requests(spark, sf_dir), *parts(spark, sf_dir)))


@query("c06_missing_tiles", LOOK + "SELECT scene_id, source_id, z, x, y, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY priority, source_id, z, x, y) AS INT) AS rank FROM lk WHERE found = 'missing' AND (scene_id + x) % 5 <> 0")
def _(spark, sf_dir):
    # Written, as they take part twice.
    r = written(requests(spark, sf_dir), "requests")
    return K.missing(r, *parts(spark, sf_dir), r.filter((C("scene_id") + C("x")) % 5 == 0))


@query("c07_coverage", LOOK + "SELECT scene_id, count(*) AS n_required, count(*) FILTER (found = 'hit') AS n_covered, count(*) FILTER (found = 'hit' AND (x + y) % 2 = 0) AS n_opaque, count(*) = count(*) FILTER (found = 'hit') AS is_full FROM lk GROUP BY scene_id")
def _(spark, sf_dir):
    return K.coverage(requests(spark, sf_dir), parts(spark, sf_dir)[0].withColumn("is_opaque", (C("x") + C("y")) % 2 == 0))


OVER = having("tile_cache") + """, a AS (SELECT * FROM tile_cache WHERE z = 5), b AS (SELECT * FROM tile_cache WHERE z <> 5),
ov AS (SELECT a.source_id, a.z AS a_z, a.x AS a_x, a.y AS a_y, b.z AS b_z, b.x AS b_x, b.y AS b_y FROM a JOIN b ON a.source_id = b.source_id AND (a.x >> greatest(0, a.z - b.z)) = (b.x >> greatest(0, b.z - a.z)) AND (a.y >> greatest(0, a.z - b.z)) = (b.y >> greatest(0, b.z - a.z)))
"""


@query("c08_tiles_overlap", OVER + "SELECT * FROM ov")
def _(spark, sf_dir):
    c = view(spark, sf_dir, "tile_cache")
    return T.overlapping(c.filter("z = 5"), c.filter("z <> 5"))


@query("c09_bounds_centre", having("points") + f""", b AS (SELECT device, min(lon) AS west, min(lat) AS south, max(lon) - 20 AS east, max(lat) AS north
  FROM points GROUP BY device),
c AS (SELECT *, ({wx('west')} + CASE
  WHEN {wx('east')} < {wx('west')} THEN 1 ELSE 0 END + {wx('east')}) / 2 AS cx, ({wy('south')} + {wy('north')}) / 2 AS cy
  FROM b) SELECT device, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north, round((cx - floor(cx)) * 360 - 180, 6) AS lon, round({LAT.format('cy')}, 6) AS lat
  FROM c""")
def _(spark, sf_dir):
    b = T.bounds_of(view(spark, sf_dir, "points"), ["device"]).withColumn("east", C("east") - 20)
    at = T.bounds_centre(C("west"), C("south"), C("east"), C("north"))
    return b.select("device", *rounded("west", "south", "east", "north"), F.round(at["lon"], 6).alias("lon"), F.round(at["lat"], 6).alias("lat"))


@query("c11_fallback_zooms", having("tile_cache") + "SELECT source_id, list_sort(list(DISTINCT z)) AS zooms FROM tile_cache WHERE z <> 5 GROUP BY source_id")
def _(spark, sf_dir):
    return T.fallback_zooms(view(spark, sf_dir, "tile_cache"), 5)


# Instances of every cached tile of a scene's active sources, whatever its zoom: worlds from the first to the last that the camera box touches.
CACHED = TILES + """, ci AS (
  SELECT scene_id, c.source_id, c.z, c.x, c.y, size * pow(2, h.z - c.z) AS s, size * pow(2, h.z) AS world, cx, cy, lx, hx, ly, hy, c.x * size * pow(2, h.z - c.z) - cx AS l0, c.y * size * pow(2, h.z - c.z) - cy AS t0, vw, vh
  FROM h JOIN ac USING (scene_id) JOIN tile_cache c USING (source_id)
), cw AS (
  SELECT *, CAST(floor((lx - l0 - s) / world) + 1 AS BIGINT) AS w0, CAST(ceil((hx - l0) / world) - 1 AS BIGINT) AS w1 FROM ci WHERE t0 < hy AND t0 + s > ly
), cr AS (
  SELECT scene_id, source_id, z, x, y, CAST(x + w * CAST(pow(2, z) AS BIGINT) AS INT) AS world_x, l0 + w * world + vw / 2 AS "left", t0 + vh / 2 AS top, s AS size
  FROM cw, unnest(range(w0, w1 + 1)) AS a(w) WHERE l0 + w * world < hx AND l0 + w * world + s > lx
)
"""


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = T.active_layers(view(spark, sf_dir, "scenes"), view(spark, sf_dir, "layers"), keep=T.CAMERA)
    return T.cached_instances(view(spark, sf_dir, "tile_cache"), None, shown)


@query("c12_cached_instances", CACHED + """SELECT scene_id, source_id, z, count(*) AS n, CAST(sum(x) AS BIGINT) AS xs, CAST(sum(y) AS BIGINT) AS ys, CAST(sum(world_x) AS BIGINT) AS wxs, round(sum("left"), 1) AS lefts, round(sum(top), 1) AS tops FROM cr GROUP BY ALL""")
def _(spark, sf_dir):
    by = instances(spark, sf_dir).groupBy("scene_id", "source_id", "z")
    return by.agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(n) for c, n in (("x", "xs"), ("y", "ys"), ("world_x", "wxs"))], F.round(F.sum("left"), 1).alias("lefts"), F.round(F.sum("top"), 1).alias("tops"))


@query("c13_redundant_tiles", having("tile_cache") + """, act AS (SELECT source_id, z, x, y, status = 'F' AS own FROM tile_cache WHERE z = 5), up AS (SELECT a.source_id, a.x, a.y, a.own, max(c.z) AS best FROM act a LEFT JOIN tile_cache c ON c.source_id = a.source_id AND c.status = 'F' AND c.z < 5 AND c.x = (a.x >> (5 - c.z)) AND c.y = (a.y >> (5 - c.z)) GROUP BY ALL),
pr AS (SELECT c.source_id, c.z, c.x, c.y, u.own OR coalesce(u.best, -1) > c.z AS ok FROM tile_cache c JOIN up u ON c.source_id = u.source_id AND c.z <> 5 AND (c.x >> greatest(0, c.z - 5)) = (u.x >> greatest(0, 5 - c.z)) AND (c.y >> greatest(0, c.z - 5)) = (u.y >> greatest(0, 5 - c.z)))
SELECT source_id, z, x, y, bool_and(ok) AS is_redundant FROM pr GROUP BY ALL""")
def _(spark, sf_dir):
    c = view(spark, sf_dir, "tile_cache")
    return K.redundant(c.filter("z <> 5"), c.filter("z = 5"), c.filter("status = 'F'"))


@query("c15_cache_budget", having("tile_cache") + "SELECT source_id, CASE WHEN p >= 117440512 THEN greatest(p, 134217728) ELSE least(greatest(p + 16777216, 33554432), 134217728) END AS budget FROM (SELECT source_id, CAST(sum(bytes) * 4 AS BIGINT) AS p FROM tile_cache GROUP BY source_id)")
def _(spark, sf_dir):
    return view(spark, sf_dir, "tile_cache").groupBy("source_id").agg((F.sum("bytes") * 4).alias("p")).select("source_id", K.budget(C("p")).alias("budget"))


LRU = having("tile_cache") + """, c AS (SELECT *, status = 'O' AS safe FROM tile_cache), t AS (SELECT source_id AS pool, sum(bytes) AS total FROM c GROUP BY 1),
e AS (SELECT c.source_id AS pool, c.source_id, z, x, y, bytes, total - coalesce(sum(bytes) OVER (PARTITION BY c.source_id ORDER BY last_used, z, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 3000000 AS gone FROM c JOIN t ON t.pool = c.source_id WHERE NOT safe)
"""


def evicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = view(spark, sf_dir, "tile_cache")
    return c, K.lru_evict(c, c.filter("status = 'O'"), limit=F.lit(3_000_000))


@query("c16_lru_evict", LRU + "SELECT pool, source_id, z, x, y, bytes FROM e WHERE gone")
def _(spark, sf_dir):
    return evicted(spark, sf_dir)[1]


@query("c16_lru_report", LRU + "SELECT t.pool, count(e.pool) AS n_evicted, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes_evicted, CAST(any_value(total) - coalesce(sum(bytes), 0) AS BIGINT) AS bytes_left FROM t LEFT JOIN e ON e.pool = t.pool AND gone GROUP BY t.pool")
def _(spark, sf_dir):
    return K.evict_report(*evicted(spark, sf_dir))


@query("c17_pyramid_children", having("tile_cache") + "SELECT DISTINCT z, x, y, 6 AS child_z, CAST(x * CAST(pow(2, 6 - z) AS INT) + dx AS INT) AS child_x, CAST(y * CAST(pow(2, 6 - z) AS INT) + dy AS INT) AS child_y FROM tile_cache, unnest(range(CAST(pow(2, 6 - z) AS BIGINT))) AS a(dx), unnest(range(CAST(pow(2, 6 - z) AS BIGINT))) AS b(dy) WHERE z < 6")
def _(spark, sf_dir):
    return T.pyramid_children(view(spark, sf_dir, "tile_cache").select("z", "x", "y").distinct(), 6)


@query("c10_fit_groups")
def _(spark, sf_dir):
    """A search for a zoom: held against a plain second implementation in the tests."""
    p = view(spark, sf_dir, "points").select("device", (C("lon") / 40 + C("device") % 300 - 150).alias("lon"), (C("lat") / 3).alias("lat"))
    return T.fit_groups(p, "device", width=1024.0, height=768.0, margins=(20.0, 40.0, 60.0, 10.0), heading=30.0, pitch=20.0)


KINDS = ("Blank", "Road", "Satellite", "SatelliteWithRoads", "RoadShadedRelief", "RoadShadedReliefRaster", "RoadRaster", "GrayscaleDarkRaster", "Night", "Unknown")


@query("c18_tilesets_for", having("scenes") + f"""
, k AS (SELECT scene_id, {list(KINDS)}[scene_id % 10 + 1] AS style, CAST(scene_id % 23 AS INT) AS zoom FROM scenes), t AS (
  SELECT *, CASE style WHEN 'Blank' THEN [] WHEN 'Road' THEN CASE WHEN zoom BETWEEN 4 AND 12 THEN ['vector', 'road-detail'] ELSE ['vector'] END WHEN 'Satellite' THEN ['imagery'] WHEN 'SatelliteWithRoads' THEN ['imagery', 'vector']
    WHEN 'RoadShadedRelief' THEN CASE WHEN zoom < 15 THEN ['terrain', 'vector'] ELSE ['vector'] END WHEN 'RoadShadedReliefRaster' THEN CASE WHEN zoom <= 6 THEN ['road', 'terrain'] ELSE ['road'] END
    WHEN 'RoadRaster' THEN ['road'] WHEN 'GrayscaleDarkRaster' THEN ['dark-grey'] WHEN 'Night' THEN ['vector'] END AS names FROM k)
SELECT scene_id, CAST(i AS INT) AS place, names[i + 1] AS tileset, CAST(CASE names[i + 1] WHEN 'imagery' THEN greatest(1, least(19, zoom)) WHEN 'terrain' THEN least(6, zoom) ELSE zoom END AS INT) AS zoom FROM t, unnest(range(len(names))) AS a(i)""")
def _(spark, sf_dir):
    style = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (C("scene_id") % 10 + 1).cast("int"))
    s = view(spark, sf_dir, "scenes").select("scene_id", F.posexplode(T.tilesets_for(style, (C("scene_id") % 23).cast("int"))).alias("place", "t"))
    return s.select("scene_id", "place", "t.tileset", "t.zoom")


# From each tile down: a cell with tiles below it falls into quarters, one without any is free.
@query("c19_exclusive_coverage", CACHED.replace("WITH ", "WITH RECURSIVE ", 1) + """, iz AS (
  SELECT cr.scene_id, source_id, z, y, world_x, size, CAST(floor(zoom) AS INT) AS zl FROM cr JOIN scenes ON scenes.scene_id = cr.scene_id
), below AS (
  SELECT DISTINCT scene_id, source_id, CAST(u AS INT) AS z, y >> CAST(z - u AS INT) AS y, world_x >> CAST(z - u AS INT) AS world_x FROM iz, unnest(range(z)) AS t(u)
), drawn AS (
  SELECT a.* FROM iz a LEFT JOIN iz b ON b.scene_id = a.scene_id AND b.source_id = a.source_id AND b.z = a.zl AND a.z > a.zl AND b.y = a.y >> CAST(greatest(0, a.z - a.zl) AS INT) AND b.world_x = a.world_x >> CAST(greatest(0, a.z - a.zl) AS INT) WHERE b.z IS NULL
), w AS (
  SELECT scene_id, source_id, z, zl, size, z AS cz, y AS cy, world_x AS cx, EXISTS (SELECT 1 FROM below b WHERE b.scene_id = d.scene_id AND b.source_id = d.source_id AND b.z = d.z AND b.y = d.y AND b.world_x = d.world_x) AND z <> zl AS deep FROM drawn d
  UNION ALL SELECT c.scene_id, c.source_id, c.z, c.zl, c.size, c.cz, c.cy, c.cx, b.z IS NOT NULL FROM (
    SELECT scene_id, source_id, z, zl, size, cz + 1 AS cz, cy * 2 + k // 2 AS cy, cx * 2 + k % 2 AS cx FROM w, unnest([0, 1, 2, 3]) AS q(k) WHERE deep) c
  LEFT JOIN below b ON b.scene_id = c.scene_id AND b.source_id = c.source_id AND b.z = c.cz AND b.y = c.cy AND b.world_x = c.cx
  LEFT JOIN iz p ON p.scene_id = c.scene_id AND p.source_id = c.source_id AND p.z = c.cz AND p.y = c.cy AND p.world_x = c.cx WHERE p.z IS NULL
)
SELECT scene_id, source_id, z, count(*) AS n_parts, round(sum(pow(size / pow(2, cz - z), 2)), 1) AS area FROM w WHERE NOT deep GROUP BY scene_id, source_id, z""")
def _(spark, sf_dir):
    shown = T.active_layers(view(spark, sf_dir, "scenes"), view(spark, sf_dir, "layers"), keep=T.CAMERA)
    return T.coverage_totals(view(spark, sf_dir, "tile_cache"), None, shown).withColumn("area", F.round("area", 1))
