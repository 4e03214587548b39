"""Queries of paint evaluation, tile statistics, geography and incident hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import mercator as M
from tilewright.jobs.fixtures import having, view
from tilewright.jobs.q_tiles import wx, wy
from tilewright.jobs.registry import query
from tilewright.operators import evaluate as V

C = F.col
FS = having("features")


@query("g02_evaluate_line", FS + """
SELECT feature_id, CASE WHEN level - 0.2 <= 0 OR rank = 3 OR height - 950 <= 0 THEN 'hidden'
  WHEN NOT ((height - 950) * 2 <= 256 AND abs(height * 5 - 4700) <= 4096 AND rank * 150 BETWEEN 0 AND 512 AND rank + 1 BETWEEN 1 AND 16) THEN 'invalid' ELSE 'drawn' END AS outcome
FROM features""")
def _(spark, sf_dir):
    f = view(spark, sf_dir, "features")
    d = lambda c: c.cast("double")
    return f.select("feature_id", V.evaluate_line((C("height") - 950) * 2, C("height") * 5 - 4700, d(C("rank") * 150), F.lit(20.0), d(C("rank") + 1), C("level") - 0.2, F.when(C("rank") == 3, 0).otherwise(255)).alias("outcome"))


@query("g03_evaluate_fill", FS + """
SELECT feature_id, CASE WHEN abs(height * 5 - 4700) > 4096 THEN 'invalid' WHEN level - 0.2 <= 0 OR rank = 3 AND feature_id % 2 = 0 THEN 'hidden' ELSE 'drawn' END AS outcome,
  CASE WHEN feature_id % 2 = 1 THEN 'own' WHEN feature_id % 3 = 0 THEN 'fill' END AS outline
FROM features""")
def _(spark, sf_dir):
    f = view(spark, sf_dir, "features")
    own = C("feature_id") % 2 == 1
    outcome = V.evaluate_fill(C("height") * 5 - 4700, F.lit(3.0), C("level") - 0.2, F.when(C("rank") == 3, 0).otherwise(255), F.when(own, 255))
    return f.select("feature_id", outcome.alias("outcome"), V.fill_outline(F.lit("fill"), F.when(own, "own"), C("feature_id") % 3 == 0).alias("outline"))


@query("g04_evaluate_text", FS + """
SELECT feature_id, CASE WHEN height / 5 > 256 OR rank * 60 > 180 OR rank - 1 < 0 THEN 'invalid' ELSE 'drawn' END AS outcome, CASE rank WHEN 0 THEN upper(name) WHEN 1 THEN lower(brand) ELSE name END AS text,
  CASE WHEN feature_id % 3 = 0 THEN 'top' WHEN feature_id % 2 = 0 THEN 'left' ELSE 'center' END AS anchor
FROM features""")
def _(spark, sf_dir):
    f = view(spark, sf_dir, "features")
    d = lambda c: c.cast("double")
    text = V.transformed(F.when(C("rank") == 1, C("brand")).otherwise(C("name")), F.when(C("rank") == 0, "uppercase").when(C("rank") == 1, "lowercase"))
    anchor = V.text_anchor(F.when(C("feature_id") % 3 == 0, F.array(F.lit("top"), F.lit("bottom"))), F.when(C("feature_id") % 2 == 0, "left"))
    return f.select("feature_id", V.evaluate_text(C("height") / 5, F.lit(10.0), F.lit(1.2), d(C("rank") - 1), d(C("rank") * 60), F.lit(1.0)).alias("outcome"), text.alias("text"), anchor.alias("anchor"))


@query("g05_evaluate_extrusion", FS + "SELECT feature_id, CASE WHEN height < 950 OR level * 2 > 1 THEN 'invalid' ELSE 'drawn' END AS outcome FROM features")
def _(spark, sf_dir):
    return view(spark, sf_dir, "features").select("feature_id", V.evaluate_extrusion(F.lit(950.0), C("height"), C("level") * 2).alias("outcome"))


@query("j09_exact_geography", having("places") + "SELECT place_id, entity_type IN ('Country', 'Municipality') AND lower(address) IN ('building', 'machinery') AND CASE entity_type WHEN 'Country' THEN lower(address) = 'building' ELSE true END AS hit FROM places")
def _(spark, sf_dir):
    p = view(spark, sf_dir, "places")
    q = F.when((C("entity_type") == "Municipality") & (F.lower("address") == "machinery"), "Machinery").otherwise("BUILDING")
    kind = F.when(C("entity_type").isin("Country", "Municipality"), "Geography").otherwise("POI")
    return p.select("place_id", V.exact_geography(q, kind, C("entity_type"), {"country": C("address"), "municipality": C("address")}, F.lit("nowhere")).alias("hit"))


@query("j12_parse_viewport", having("places") + "SELECT place_id, CASE WHEN k AND lat + 5 <= 90 THEN round(lon, 6) END AS west, CASE WHEN k AND lat + 5 <= 90 THEN round(lat - 1, 6) END AS south, CASE WHEN k AND lat + 5 <= 90 THEN round(lon / 2, 6) END AS east, CASE WHEN k AND lat + 5 <= 90 THEN round(lat + 5, 6) END AS north, k AND lat + 5 > 90 OR place_id % 4 = 1 AS error FROM (SELECT *, place_id % 4 > 1 AS k FROM (SELECT place_id, lon, lat * 1.1 AS lat FROM places))")
def _(spark, sf_dir):
    p = view(spark, sf_dir, "places").withColumn("lat", C("lat") * 1.1)
    pt = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    full = F.to_json(F.struct(F.struct(pt(C("lat") + 5, C("lon")).alias("topLeftPoint"), pt(C("lat") - 1, C("lon") / 2).alias("btmRightPoint")).alias("viewport")))
    text = F.when(C("place_id") % 4 == 0, "{}").when(C("place_id") % 4 == 1, '{"viewport":{"topLeftPoint":{"lat":1,"lon":2}}}').otherwise(full)
    got = V.parse_viewport(text)
    return p.select("place_id", *[F.round(v, 6).alias(k) if k != "error" else v.alias(k) for k, v in got.items()])


HITS = having("points") + f""", t AS (SELECT point_id, {wx('lon')} * 1024 AS x, {wy('lat')} * 1024 AS y FROM points),
ic AS (SELECT point_id AS incident_id, x, y FROM t WHERE point_id % 3 = 0),
ln AS (SELECT point_id AS incident_id, x, y, x + 30 AS nx, y + 12 AS ny FROM t WHERE point_id % 3 = 1),
tp AS (SELECT point_id AS tap_id, x + 4 AS px, y + 3 AS py FROM t WHERE point_id % 3 = 2),
a AS (SELECT tap_id, 0 AS k, pow(px - x, 2) + pow(py - y, 2) AS d, incident_id FROM tp, ic WHERE py - y + 16 BETWEEN 0 AND 32 AND abs(px - x) <= (py - y + 16) / 2),
b0 AS (SELECT *, greatest(0, least(1, ((px - x) * 30 + (py - y) * 12) / 1044.0)) AS u FROM tp, ln),
b AS (SELECT tap_id, 1 AS k, pow(px - x - u * 30, 2) + pow(py - y - u * 12, 2) AS d, incident_id FROM b0),
r AS (SELECT *, row_number() OVER (PARTITION BY tap_id ORDER BY k, d, incident_id) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE d <= 64))
"""


@query("i04_nearest_incident", HITS + "SELECT tap_id, incident_id, k = 1 AS is_line FROM r WHERE n = 1")
def _(spark, sf_dir):
    t = view(spark, sf_dir, "points").select("point_id", (M.lon_to_world_x(C("lon")) * 1024).alias("x"), (M.lat_to_world_y(C("lat")) * 1024).alias("y"))
    of = lambda k: t.filter(C("point_id") % 3 == k)
    lines = of(1).select(C("point_id").alias("incident_id"), "x", "y", (C("x") + 30).alias("nx"), (C("y") + 12).alias("ny"))
    return V.nearest_incident(of(2).select(C("point_id").alias("tap_id"), (C("x") + 4).alias("px"), (C("y") + 3).alias("py")), of(0).select(C("point_id").alias("incident_id"), "x", "y"), lines)
