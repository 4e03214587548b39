"""Queries of the path, polygon and hit-test jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import mercator as M
from tilewright.jobs.fixtures import having, view
from tilewright.jobs.q_tiles import boxes, wx, wy
from tilewright.jobs.registry import query
from tilewright.operators import geometry as G
from tilewright.operators import hittest as H
from tilewright.operators import labels as L

C = F.col


def rounded(df, places, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


PATHS = having("tracks") + f""", w AS (
  SELECT path_id, contour, i, {wx('lon')} AS wx0, {wy('lat')} AS y FROM tracks
), d AS (
  SELECT *, coalesce(wx0 - lag(wx0) OVER (PARTITION BY path_id, contour ORDER BY i), 0) AS dx FROM w
), p AS (
  SELECT path_id, contour, i, wx0 - sum(round_even(dx, 0)) OVER (PARTITION BY path_id, contour ORDER BY i) AS x, y FROM d
), s AS (
  SELECT *, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM p WINDOW o AS (PARTITION BY path_id, contour ORDER BY i)
), sg AS (
  SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM s WHERE nx IS NOT NULL
), rl AS (
  SELECT *, coalesce(sum(len) OVER (PARTITION BY path_id, contour ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(len) OVER (PARTITION BY path_id, contour) AS total FROM sg
)
"""


def paths(spark, sf_dir):
    return G.build_paths(view(spark, sf_dir, "tracks"))


@query("e01_build_paths", PATHS + "SELECT path_id, contour, i, round(x, 9) AS x, round(y, 9) AS y FROM p")
def _(spark, sf_dir):
    return rounded(paths(spark, sf_dir), 9, "x", "y")


# Shapes: the oracle takes unwrapped longitudes as they are, which differ from the operator's by whole worlds only.
SHAPES = having("polygons", "points", "elements") + f""", v AS (
  SELECT shape_id, contour, i, (lon + 180) / 360 AS x, {wy('lat')} AS y FROM polygons
), e AS (
  SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM v WINDOW o AS (PARTITION BY shape_id, contour ORDER BY i)
), ar AS (
  SELECT shape_id, contour, sum(x * ny - nx * y) / 2 AS area, count(*) AS n FROM e GROUP BY ALL
), b AS (
  SELECT shape_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, avg(x) AS ax FROM v GROUP BY ALL
), pt AS (
  SELECT point_id, {wx('lon')} AS x, {wy('lat')} AS y FROM points
), pc AS (
  SELECT point_id, shape_id, x + k AS px, y AS py FROM pt JOIN (SELECT *, k FROM b, unnest([-1, 0, 1]) AS u(k)) b ON x + k BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND k = round_even(ax - x, 0)
), pin AS (
  SELECT point_id, pc.shape_id, sum(CASE WHEN (e.y > py) <> (e.ny > py) AND px < (e.nx - e.x) * (py - e.y) / (e.ny - e.y) + e.x THEN 1 ELSE 0 END) % 2 = 1 AS hit FROM pc JOIN e ON e.shape_id = pc.shape_id GROUP BY ALL
)
"""


def shapes(spark, sf_dir):
    v = view(spark, sf_dir, "polygons").withColumnRenamed("shape_id", "path_id")
    return G.align_contours(G.build_paths(v))


def world_points(spark, sf_dir):
    return view(spark, sf_dir, "points").select("point_id", M.lon_to_world_x(C("lon")).alias("x"), M.lat_to_world_y(C("lat")).alias("y"))


@query("e01_path_errors", having("tracks") + "SELECT path_id, contour, 'a position is not finite' AS error FROM tracks WHERE i % 1000 = 7 GROUP BY ALL")
def _(spark, sf_dir):
    t = view(spark, sf_dir, "tracks")
    return G.path_errors(t.withColumn("lat", F.when(C("i") % 1000 == 7, float("nan")).otherwise(C("lat"))))


@query("e02_align_contours", SHAPES + "SELECT shape_id, contour, i, round(x - ax, 9) AS dx, round(y, 9) AS y FROM v JOIN b USING (shape_id)")
def _(spark, sf_dir):
    return shapes(spark, sf_dir).select(C("path_id").alias("shape_id"), "contour", "i", F.round(C("x") - C("anchor_x"), 9).alias("dx"), F.round("y", 9).alias("y"))


@query("e03_ring_area", SHAPES + "SELECT shape_id, contour, round(area, 12) AS area, n FROM ar")
def _(spark, sf_dir):
    return G.ring_area(shapes(spark, sf_dir)).select(C("path_id").alias("shape_id"), "contour", F.round("area", 12).alias("area"), "n")


@query("e04_group_rings", SHAPES + "SELECT shape_id, contour, CAST(sum(CASE WHEN -area > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY shape_id ORDER BY contour) AS BIGINT) AS polygon FROM ar")
def _(spark, sf_dir):
    areas = G.ring_area(shapes(spark, sf_dir)).withColumn("area", -C("area"))
    return G.group_rings(areas).select(C("path_id").alias("shape_id"), "contour", C("polygon").cast("long").alias("polygon"))


@query("e05_bounding_boxes", PATHS + "SELECT path_id, round(min(x), 9) AS x0, round(min(y), 9) AS y0, round(max(x), 9) AS x1, round(max(y), 9) AS y1 FROM p GROUP BY path_id")
def _(spark, sf_dir):
    return rounded(G.bounding_boxes(paths(spark, sf_dir), ["path_id"]), 9, "x0", "y0", "x1", "y1")


@query("e06_bbox_join", having("points") + f", a AS (SELECT point_id AS id, {wx('lon')} * 0.9 AS x0, {wy('lat')} * 0.9 AS y0 FROM points), k AS (SELECT id, x0, y0, x0 + 0.01 AS x1, y0 + 0.008 AS y1 FROM a) SELECT a.id AS a_id, b.id AS b_id FROM k a JOIN k b ON a.id % 2 = 0 AND b.id % 2 = 1 AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0")
def _(spark, sf_dir):
    k = world_points(spark, sf_dir).select(C("point_id").alias("id"), (C("x") * 0.9).alias("x0"), (C("y") * 0.9).alias("y0")).withColumns({"x1": C("x0") + 0.01, "y1": C("y0") + 0.008})
    return G.bbox_pairs(k.filter("id % 2 = 0"), k.filter("id % 2 = 1"))


def paired(spark, sf_dir, pairs):
    """Points and the shapes that pairs finds for them: points at one place meet shapes as one."""
    members, places = G.places_of(world_points(spark, sf_dir))
    return G.point_pairs(members, pairs(places)).select("point_id", C("path_id").alias("shape_id"))


@query("e07_points_in_polygons", SHAPES + "SELECT point_id, shape_id FROM pin WHERE hit")
def _(spark, sf_dir):
    return paired(spark, sf_dir, lambda places: G.points_in_polygons(places, shapes(spark, sf_dir)))


D2 = "greatest(0, least(1, ((0.3 - x) * (nx - x) + (0.4 - y) * (ny - y)) / nullif(len * len, 0)))"


@query("e09_segment_distance2", PATHS + f", t AS (SELECT *, coalesce({D2}, 0) AS t FROM sg) SELECT path_id, contour, i, round(pow(0.3 - (x + t * (nx - x)), 2) + pow(0.4 - (y + t * (ny - y)), 2), 9) AS d2 FROM t")
def _(spark, sf_dir):
    s = G.segments(paths(spark, sf_dir))
    return s.select("path_id", "contour", "i", F.round(G.segment_distance2(F.lit(0.3), F.lit(0.4), C("x"), C("y"), C("nx"), C("ny")), 9).alias("d2"))


CUT = PATHS + """, tl AS (SELECT *, CAST(floor(least(x, nx) * 64) AS INT) AS tx0, CAST(floor(greatest(x, nx) * 64) AS INT) AS tx1, CAST(floor(least(y, ny) * 64) AS INT) AS ty0, CAST(floor(greatest(y, ny) * 64) AS INT) AS ty1 FROM sg),
tt AS (SELECT path_id, contour, i, x, y, nx, ny, CAST(a.u AS INT) AS tx, CAST(b.u AS INT) AS ty FROM tl, unnest(range(tx0, tx1 + 1)) AS a(u), unnest(range(ty0, ty1 + 1)) AS b(u)),
tc AS (SELECT *, greatest(0, coalesce(least((tx / 64.0 - x) / nullif(nx - x, 0), ((tx + 1) / 64.0 - x) / nullif(nx - x, 0)), 0), coalesce(least((ty / 64.0 - y) / nullif(ny - y, 0), ((ty + 1) / 64.0 - y) / nullif(ny - y, 0)), 0)) AS a, least(1, coalesce(greatest((tx / 64.0 - x) / nullif(nx - x, 0), ((tx + 1) / 64.0 - x) / nullif(nx - x, 0)), 1), coalesce(greatest((ty / 64.0 - y) / nullif(ny - y, 0), ((ty + 1) / 64.0 - y) / nullif(ny - y, 0)), 1)) AS b FROM tt)
"""


@query("e10_split_by_tile", CUT + "SELECT path_id, contour, i, tx, ty, round(x + (nx - x) * a, 7) AS x, round(y + (ny - y) * a, 7) AS y, round(x + (nx - x) * b, 7) AS nx, round(y + (ny - y) * b, 7) AS ny FROM tc WHERE a < b")
def _(spark, sf_dir):
    return rounded(G.split_by_tile(G.segments(paths(spark, sf_dir)), 6), 7, "x", "y", "nx", "ny")


@query("e11_split_polygons", SHAPES + """, bx AS (SELECT shape_id, contour, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, min(CASE WHEN contour = 0 THEN 1 ELSE -1 END) AS turn FROM v GROUP BY ALL),
t AS (SELECT *, CAST(a.u AS INT) AS tx, CAST(b.u AS INT) AS ty FROM bx, unnest(range(CAST(floor(x0 * 256) AS BIGINT), CAST(floor(x1 * 256) AS BIGINT) + 1)) AS a(u), unnest(range(CAST(floor(y0 * 256) AS BIGINT), CAST(floor(y1 * 256) AS BIGINT) + 1)) AS b(u)),
c AS (SELECT *, turn * (least(x1, (tx + 1) / 256.0) - greatest(x0, tx / 256.0)) * (least(y1, (ty + 1) / 256.0) - greatest(y0, ty / 256.0)) AS area FROM t)
SELECT shape_id, contour, CAST(tx + 256 AS INT) % 256 AS tx, ty, round(abs(area) * 1e9, 0) AS area FROM c WHERE abs(area) > 1e-15""")
def _(spark, sf_dir):
    cut = G.split_polygons_by_tile(shapes(spark, sf_dir), 8)
    n = F.size("xs")
    at = lambda c, k: F.get(c, F.pmod(k, n))
    area = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + at("xs", k) * at("ys", k + 1) - at("xs", k + 1) * at("ys", k)) / 2
    return cut.select(C("path_id").alias("shape_id"), "contour", F.pmod("tx", F.lit(256)).cast("int").alias("tx"), "ty", F.round(F.abs(area) * 1e9, 0).alias("area"))


@query("e12_path_length", PATHS + """, m AS (
  SELECT *, row_number() OVER (PARTITION BY path_id, contour ORDER BY i) AS k FROM rl WHERE bf <= total / 2 AND bf + len >= total / 2 AND len > 0)
SELECT path_id, contour, round(total, 7) AS length, round(x + (nx - x) * (total / 2 - bf) / len, 7) AS mid_x, round(y + (ny - y) * (total / 2 - bf) / len, 7) AS mid_y FROM m WHERE k = 1""")
def _(spark, sf_dir):
    return rounded(G.path_length(G.segments(paths(spark, sf_dir))), 7, "length", "mid_x", "mid_y")


# The point at a share of a path's length, and where its neighbourhood leads. A distance takes the last segment that begins before it, and a path ends where its last segment does: sums that
# are rounded leave gaps between one segment's end and the next one's beginning, and behind the last one.
ALONG = PATHS + """, qt AS (SELECT path_id, contour, max(total) AS total, max(bf + len) FILTER (len > 1e-7) AS ending FROM rl GROUP BY path_id, contour), q AS (SELECT path_id, contour, ending, total * (0.1 + (path_id % 9) / 10.0) AS d FROM qt), qq AS (SELECT path_id, contour, ending, d, k, CASE k WHEN 0 THEN d WHEN 1 THEN greatest(0, d - 0.01) ELSE least(ending, d + 0.01) END AS dk FROM q, unnest([0, 1, 2]) AS u(k)),
pl AS (SELECT q.path_id, q.contour, d, k, arg_max(x + (nx - x) * (dk - bf) / len, bf) AS ax, arg_max(y + (ny - y) * (dk - bf) / len, bf) AS ay FROM qq q JOIN rl ON rl.path_id = q.path_id AND rl.contour = q.contour AND len > 1e-7 AND dk BETWEEN 0 AND ending AND (dk > bf OR dk = 0 AND bf = 0) GROUP BY q.path_id, q.contour, d, k),
wd AS (SELECT path_id, contour, d, max(ax) FILTER (k = 0) AS x, max(ay) FILTER (k = 0) AS y, max(ax) FILTER (k = 2) - max(ax) FILTER (k = 1) AS dx, max(ay) FILTER (k = 2) - max(ay) FILTER (k = 1) AS dy FROM pl GROUP BY ALL)
"""


@query("e13_point_along", ALONG + "SELECT path_id, contour, round(d, 6) AS distance, round(x, 6) AS x, round(y, 6) AS y, round(dx / sqrt(dx * dx + dy * dy), 5) AS tangent_x, round(dy / sqrt(dx * dx + dy * dy), 5) AS tangent_y FROM wd")
def _(spark, sf_dir):
    segs = G.segments(paths(spark, sf_dir))
    total = G.path_length(segs).select("path_id", "contour", (C("length") * (0.1 + (C("path_id") % 9) / 10)).alias("distance"))
    return rounded(rounded(G.point_along(segs, total, 0.01), 6, "distance", "x", "y"), 5, "tangent_x", "tangent_y")


# Paths in pixels of zoom 0, where symbols of 10 are placed every 16.
PIXELS = PATHS.replace("AS x, y FROM d", "AS x0, y AS y0 FROM d").replace("s AS (\n  SELECT *,", "p2 AS (SELECT path_id, contour, i, x0 * 256 AS x, y0 * 256 AS y FROM p), s AS (\n  SELECT *,").replace("ny FROM p WINDOW", "ny FROM p2 WINDOW")
PLACED = """ SELECT path_id, contour, k, round(distance, 6) AS distance, round(x + (nx - x) * (distance - bf) / len, 5) AS x, round(y + (ny - y) * (distance - bf) / len, 5) AS y, round((nx - x) / len, 5) AS tangent_x, round((ny - y) / len, 5) AS tangent_y
FROM c JOIN rl USING (path_id, contour) WHERE len > 0 AND (distance > bf OR distance = 0) AND distance <= bf + len"""


def placed(spark, sf_dir, **how):
    p = paths(spark, sf_dir).withColumns({"x": C("x") * 256, "y": C("y") * 256})
    return rounded(rounded(G.place_along(G.segments(p), 12.0, 10.0, **how), 6, "distance"), 5, "x", "y", "tangent_x", "tangent_y")


@query("e14_place_along", PIXELS + ", t AS (SELECT path_id, contour, any_value(total) AS total FROM rl GROUP BY ALL HAVING any_value(total) >= 18), c AS (SELECT path_id, contour, total, k, least(16.0, total) / 2 + k * 16 AS distance FROM t, unnest(range(greatest(1, least(4096, CAST(floor(total / 16) AS BIGINT))))) AS g(k))" + PLACED + " AND distance - 5 >= 4 AND distance + 5 <= c.total - 4")
def _(spark, sf_dir):
    return placed(spark, sf_dir)


@query("e14_place_continuous", PIXELS + ", t AS (SELECT path_id, contour, any_value(total) AS total FROM rl GROUP BY ALL HAVING any_value(total) >= 10), c AS (SELECT path_id, contour, k, 5 + k * 12.0 AS distance FROM t, unnest(range(greatest(1, least(4096, CAST(floor((total - 10) / 12) AS BIGINT) + 1)))) AS g(k))" + PLACED)
def _(spark, sf_dir):
    return placed(spark, sf_dir, continuous=True)


@query("e15_dash_paths", PATHS + """, dd AS (SELECT *, CAST(q AS BIGINT) AS dash FROM rl, unnest(range(CAST(floor(bf / 0.0025) AS BIGINT), CAST(floor((bf + len) / 0.0025) AS BIGINT) + 1)) AS g(q) WHERE len > 0), ab AS (SELECT *, greatest(q * 0.0025 - bf, 0) / len AS a, least((q * 0.0025 + 0.0015 - bf) / len, 1) AS b FROM dd)
SELECT path_id, contour, i, dash, round(x + (nx - x) * a, 6) AS x, round(y + (ny - y) * a, 6) AS y, round(x + (nx - x) * b, 6) AS nx, round(y + (ny - y) * b, 6) AS ny FROM ab WHERE a < b""")
def _(spark, sf_dir):
    return rounded(G.dash_paths(G.segments(paths(spark, sf_dir)), [0.0015, 0.001]), 6, "x", "y", "nx", "ny")


# Dashes of 0.0006, none, 0.0009 and the same again: an odd pattern of a line 0.0003 wide, with a length of zero.
@query("e16_dash_pattern", PATHS + """, dd AS (SELECT *, CAST(q AS BIGINT) AS q FROM rl, unnest(range(CAST(floor(bf / 0.003) AS BIGINT), CAST(floor((bf + len) / 0.003) AS BIGINT) + 1)) AS g(q) WHERE len > 0),
o AS (SELECT dd.*, q * 3 + k AS dash, q * 0.003 + lo AS a0, q * 0.003 + hi AS b0 FROM dd, (VALUES (0, 0.0, 0.0006), (1, 0.0006, 0.0015), (2, 0.0021, 0.0021)) AS v(k, lo, hi) WHERE hi > lo), ab AS (SELECT *, greatest(a0 - bf, 0) / len AS a, least((b0 - bf) / len, 1) AS b FROM o)
SELECT path_id, contour, i, dash, round(x + (nx - x) * a, 6) AS x, round(y + (ny - y) * a, 6) AS y, round(x + (nx - x) * b, 6) AS nx, round(y + (ny - y) * b, 6) AS ny FROM ab WHERE a < b""")
def _(spark, sf_dir):
    return rounded(G.dash_pattern(G.segments(paths(spark, sf_dir)), [2.0, 0.0, 3.0], 0.0003), 6, "x", "y", "nx", "ny")


# Normals of the segments before and behind a point; tracks are open paths.
OFFSET = PATHS + """, n0 AS (SELECT *, x - lag(x) OVER o AS px, y - lag(y) OVER o AS py, lead(x) OVER o - x AS qx, lead(y) OVER o - y AS qy FROM p WINDOW o AS (PARTITION BY path_id, contour ORDER BY i)),
n1 AS (SELECT *, CASE WHEN sqrt(px * px + py * py) > 1e-7 THEN py / sqrt(px * px + py * py) END AS pu, CASE WHEN sqrt(px * px + py * py) > 1e-7 THEN -px / sqrt(px * px + py * py) END AS pv,
  CASE WHEN sqrt(qx * qx + qy * qy) > 1e-7 THEN qy / sqrt(qx * qx + qy * qy) END AS qu, CASE WHEN sqrt(qx * qx + qy * qy) > 1e-7 THEN -qx / sqrt(qx * qx + qy * qy) END AS qv FROM n0),
n2 AS (SELECT path_id, contour, i, x, y, coalesce(pu, qu) AS pu, coalesce(pv, qv) AS pv, coalesce(qu, pu) AS qu, coalesce(qv, pv) AS qv FROM n1),
n3 AS (SELECT *, sqrt(pow(pu + qu, 2) + pow(pv + qv, 2)) AS m FROM n2), n4 AS (SELECT *, CASE WHEN m > 1e-7 THEN ((pu + qu) * qu + (pv + qv) * qv) / m END AS h FROM n3)
"""
SCALE = "CASE WHEN abs(h) <= 0.25 THEN 0.001 ELSE greatest(-0.004, least(0.004, 0.001 / h)) END"


@query("e17_offset_paths", OFFSET + f"SELECT path_id, contour, i, round(coalesce(x + CASE WHEN m <= 1e-7 THEN qu * 0.001 ELSE (pu + qu) / m * {SCALE} END, x), 8) AS x, round(coalesce(y + CASE WHEN m <= 1e-7 THEN qv * 0.001 ELSE (pv + qv) / m * {SCALE} END, y), 8) AS y FROM n4")
def _(spark, sf_dir):
    return rounded(G.offset_paths(paths(spark, sf_dir), 0.001), 8, "x", "y")


# A side of the hull has no point to its right, and none beyond its ends. Places are whole numbers, so that what lies on a line is on it.
@query("e19_convex_hull", PATHS + """, g AS (SELECT DISTINCT path_id, CAST(round(x * 10000000) AS BIGINT) AS x, CAST(round(y * 10000000) AS BIGINT) AS y FROM p), sides AS (
  SELECT a.path_id, a.x, a.y FROM g a JOIN g b ON b.path_id = a.path_id AND (b.x <> a.x OR b.y <> a.y) JOIN g c ON c.path_id = a.path_id GROUP BY a.path_id, a.x, a.y, b.x, b.y
  HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0)
), corners AS (
  SELECT path_id, x, y FROM sides UNION SELECT path_id, min(x), min(y) FROM g GROUP BY path_id HAVING count(*) = 1
), ends AS (
  SELECT path_id, min({'x': x, 'y': y}) AS low, max({'x': x, 'y': y}) AS high FROM corners GROUP BY path_id
), upper AS (
  SELECT c.*, CASE WHEN x = high.x AND y = high.y AND low <> high OR (high.x - low.x) * (y - low.y) - (high.y - low.y) * (x - low.x) > 0 THEN 1 ELSE 0 END AS up FROM corners c JOIN ends USING (path_id)
)
SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY up, CASE WHEN up = 1 THEN -x ELSE x END, CASE WHEN up = 1 THEN -y ELSE y END) - 1 AS INT) AS k, x, y FROM upper""")
def _(spark, sf_dir):
    whole = lambda c: F.round(C(c) * 10_000_000).alias(c)
    return G.convex_hull(paths(spark, sf_dir).select("path_id", whole("x"), whole("y")), "path_id").select("path_id", "k", C("x").cast("long").alias("x"), C("y").cast("long").alias("y"))


@query("e19_is_convex", having("polygons") + "SELECT shape_id, count(DISTINCT contour) = 1 AS is_convex FROM polygons GROUP BY shape_id")
def _(spark, sf_dir):
    """Boxes are convex, and boxes with a hole are not."""
    return G.is_convex(shapes(spark, sf_dir)).select(C("path_id").alias("shape_id"), "is_convex")


# Strokes of the shapes' outlines, 0.0012 wide: a box about each side, and a circle about each corner.
STROKES = SHAPES + """, st AS (SELECT shape_id, x, y, nx, ny, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS l FROM e), sp AS (
  SELECT point_id, shape_id, st.x, st.y, nx, ny, l, pt.x + k AS px, pt.y AS py FROM st, pt, unnest([-1, 0, 1]) AS u(k)
  WHERE pt.x + k BETWEEN least(st.x, nx) - 0.0006 AND greatest(st.x, nx) + 0.0006 AND pt.y BETWEEN least(st.y, ny) - 0.0006 AND greatest(st.y, ny) + 0.0006
), hit AS (
  SELECT DISTINCT point_id, shape_id FROM sp WHERE l > 1e-6 AND (((px - x) * (nx - x) + (py - y) * (ny - y)) / l BETWEEN 0 AND l AND abs((px - x) * (ny - y) - (py - y) * (nx - x)) / l <= 0.0006 OR pow(px - nx, 2) + pow(py - ny, 2) <= 0.0006 * 0.0006)
)
"""


@query("e08_points_on_strokes", STROKES + "SELECT * FROM hit")
def _(spark, sf_dir):
    return paired(spark, sf_dir, lambda places: G.points_on_strokes(places, G.edges(shapes(spark, sf_dir)), F.lit(0.0012), closed=True))


# Cells of the grid that a scene's camera box touches, widened by how far icons reach.
CELLS = having("scenes", "elements") + "," + boxes() + f""", r AS (
  SELECT max(width * greatest(abs(anchor_x), abs(1 - anchor_x))) AS rx, max(height * greatest(abs(anchor_y), abs(1 - anchor_y))) AS ry FROM elements WHERE is_visible
), f9 AS (
  SELECT scene_id, {wx('lon')} AS x, {wy('lat')} AS y, (lx - rx * s) / w AS lx, (hx + rx * s) / w AS hx, (ly - ry * s) / w AS ly, (hy + ry * s) / w AS hy FROM (SELECT *, 1 / greatest(cos(radians(pitch)), 0.5) AS s, size * pow(2, z) AS w FROM bx), r
), g AS (
  SELECT scene_id, CAST(floor((x + lx) * 64) AS INT) AS x0, CAST(floor((x + hx) * 64) AS INT) AS x1, greatest(0, CAST(floor((y + ly) * 64) AS INT)) AS y0, least(63, CAST(floor((y + hy) * 64) AS INT)) AS y1, hx - lx >= 1 OR hy - ly >= 1 OR floor((x + hx) * 64) - floor((x + lx) * 64) + 1 >= 64 AS everything FROM f9
), ic AS (
  SELECT element_id, row_number() OVER (ORDER BY layer_index, z_index, collection_index, element_id) AS draw, layer_index, CAST(least(63, floor({wx('lon')} * 64)) AS INT) AS cx, CAST(greatest(0, least(63, floor({wy('lat')} * 64))) AS INT) AS cy FROM elements WHERE is_visible
)
"""


@query("i01_icons_in_view", CELLS + """SELECT scene_id, count(*) AS n, CAST(sum(element_id) AS BIGINT) AS ids, arg_min(element_id, draw) AS first_id, arg_max(element_id, draw) AS last_id
FROM g JOIN ic ON everything OR cy BETWEEN y0 AND y1 AND ((cx - x0) % 64 + 64) % 64 <= x1 - x0 GROUP BY scene_id""")
def _(spark, sf_dir):
    """Icons of each scene: their number, the sum of their ids, the first and the last."""
    return H.icon_totals_in_view(L.element_order(view(spark, sf_dir, "elements")), view(spark, sf_dir, "scenes"))


@query("i02_topmost_icon", having("points", "elements") + f""", o AS (SELECT *, row_number() OVER (ORDER BY layer_index, z_index, collection_index, element_id) AS draw
  FROM elements
  WHERE is_visible),
b AS (SELECT element_id, draw, {wx('lon')} * 8192 - width * 0.5 AS x0, {wy('lat')} * 8192 - height AS y0, width, height
  FROM o
  WHERE is_enabled),
t AS (SELECT point_id AS tap_id, {wx('(lon + 0.2)')} * 8192 AS tx, {wy('(lat + 0.1)')} * 8192 AS ty
  FROM points) SELECT tap_id, arg_max(element_id, draw) AS element_id
  FROM t
  JOIN b ON tx + round_even((x0 - tx) / 8192, 0) * 8192 >= x0 AND tx + round_even((x0 - tx) / 8192, 0) * 8192 < x0 + width AND ty >= y0 AND ty < y0 + height GROUP BY tap_id""")
def _(spark, sf_dir):
    taps = view(spark, sf_dir, "points").select(C("point_id").alias("tap_id"), (C("lon") + 0.2).alias("lon"), (C("lat") + 0.1).alias("lat"))
    return H.topmost_icon(taps, L.element_order(view(spark, sf_dir, "elements")), 5.0)


@query("i03_topmost_element", STROKES + """, q AS (SELECT DISTINCT shape_id, order_index, fill_alpha FROM polygons WHERE is_enabled AND is_visible AND order_index > 20), h AS (
  SELECT point_id, q.shape_id, order_index FROM pin JOIN q USING (shape_id) WHERE hit AND fill_alpha <> 0 UNION ALL SELECT point_id, q.shape_id, order_index FROM hit JOIN q USING (shape_id) WHERE q.shape_id % 4 <> 0)
SELECT point_id, arg_max(shape_id, order_index) AS element_id FROM h GROUP BY point_id""")
def _(spark, sf_dir):
    e = view(spark, sf_dir, "polygons").select(C("shape_id").alias("element_id"), "order_index", "fill_alpha", "is_enabled", "is_visible").distinct()
    e = e.withColumns({"is_polygon": F.lit(True), "stroke_alpha": F.when(C("element_id") % 4 != 0, 255).otherwise(0), "stroke_width": F.lit(0.0012)})
    return H.topmost_element(world_points(spark, sf_dir), shapes(spark, sf_dir), e, 20)
