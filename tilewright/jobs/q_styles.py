"""Queries of the rule compiler and of style layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions.colors import parse_color
from tilewright.functions.rules import compile_expression, compile_filter
from tilewright.jobs.fixtures import having, view
from tilewright.jobs.q_tiles import LAT
from tilewright.jobs.registry import query
from tilewright.operators import styles as S
from tilewright.sources.tables import read_style

PROPERTIES = ["name", "rank", "level", "brand", "height", "opt"]
FEATURES = having("features") + ", f AS (SELECT *, CASE WHEN feature_id % 4 <> 0 THEN level END AS opt FROM features)\n"

#: A rule, and the same in SQL over f: value, and whether it fails.
RULES = {
    "f02_get": (["get", "opt"], "opt", "false"),
    "f03_has": (["has", "opt"], "opt IS NOT NULL", "false"),
    "f04_geometry": (["geometry-type"], "geometry_type", "false"),
    "f06_equal": (["==", ["get", "opt"], 0.5], "opt IS NOT DISTINCT FROM 0.5", "false"),
    "f06_equal_kinds": (["!=", ["get", "name"], 3], "NOT (name IS NULL AND 3 IS NULL)", "false"),
    "f07_order": ([">=", ["get", "opt"], 0.4], "coalesce(opt >= 0.4, false)", "opt IS NULL"),
    "f07_order_text": (["<", ["get", "name"], "m"], "name < 'm'", "false"),
    "f08_not": (["!", [">", ["get", "rank"], 2]], "NOT rank > 2", "false"),
    "f09_all": (["all", ["==", ["get", "rank"], 1], [">", ["get", "opt"], 0.2]], "CASE WHEN rank <> 1 THEN false ELSE coalesce(opt > 0.2, false) END", "rank = 1 AND opt IS NULL"),
    "f09_any": (["any", [">", ["get", "rank"], 2], [">", ["get", "opt"], 0.2]], "CASE WHEN rank > 2 THEN true ELSE coalesce(opt > 0.2, false) END", "rank <= 2 AND opt IS NULL"),
    "f10_in": (["in", ["get", "brand"], ["literal", ["Brand#1", "Brand#2", "Brand#3"]]], "brand IN ('Brand#1', 'Brand#2', 'Brand#3')", "false"),
    "f11_case": (["case", ["==", ["get", "rank"], 0], "a", [">", ["get", "opt"], 0.5], "b", "c"], "CASE WHEN rank = 0 THEN 'a' WHEN opt > 0.5 THEN 'b' ELSE 'c' END", "rank <> 0 AND opt IS NULL"),
    "f12_coalesce": (["coalesce", ["get", "opt"], ["+", ["get", "rank"], 10]], "coalesce(opt, rank + 10)", "false"),
    "f13_concat": (["concat", ["get", "name"], "-", ["get", "rank"], "/", ["get", "gone"]], "concat(name, '-', rank, '/')", "false"),
    "f14_match": (["match", ["get", "rank"], [0, 1], "low", 4, "high", "mid"], "CASE WHEN rank IN (0, 1) THEN 'low' WHEN rank = 4 THEN 'high' ELSE 'mid' END", "false"),
    "f15_step": (["step", ["get", "opt"], "s", 0.25, "m", 0.75, "l"], "CASE WHEN opt < 0.25 THEN 's' WHEN opt < 0.75 THEN 'm' ELSE 'l' END", "opt IS NULL"),
    "f16_interpolate": (["interpolate", ["linear"], ["get", "rank"], 1, 10, 3, 20], "CASE WHEN rank <= 1 THEN 10 WHEN rank < 3 THEN 10 + 10 * (rank - 1) / 2.0 ELSE 20 END", "false"),
    "f16_exponential": (["interpolate", ["exponential", 2], ["get", "rank"], 0, 0, 4, 15], "CASE WHEN rank <= 0 THEN 0 WHEN rank < 4 THEN 15 * (pow(2, rank) - 1) / 15 ELSE 15 END", "false"),
    "f17_let": (["let", "a", ["+", ["get", "rank"], 1], ["*", ["var", "a"], ["var", "a"]]], "CAST((rank + 1) * (rank + 1) AS DOUBLE)", "false"),
    "f18_to_string": (["to-string", ["get", "rank"]], "CAST(rank AS VARCHAR)", "false"),
    "f19_sum": (["+", ["get", "opt"], 1, ["zoom"]], "opt + 1 + 7", "opt IS NULL"),
    "f20_number": (["number", ["get", "name"], ["get", "opt"], 9], "coalesce(opt, 9)", "false"),
    "f13_format": (["format", ["get", "name"], {"font-scale": 0.8}, " ", {}, ["get", "rank"]], "concat(name, ' ', rank)", "false"),
    "f16_colors": (["interpolate", ["linear"], ["get", "rank"], 0, "#000", 4, "rgba(255, 255, 255, 1)"], "CASE rank WHEN 0 THEN '#000' WHEN 1 THEN '#404040FF' WHEN 2 THEN '#808080FF' WHEN 3 THEN '#BFBFBFFF' ELSE 'rgba(255, 255, 255, 1)' END", "false"),
    "f23_categorical": ({"property": "brand", "type": "categorical", "stops": [["Brand#1", "a"], ["Brand#2", "b"]], "default": "c"}, "CASE brand WHEN 'Brand#1' THEN 'a' WHEN 'Brand#2' THEN 'b' ELSE 'c' END", "false"),
    "f23_interval": ({"property": "opt", "type": "interval", "stops": [[0, "s"], [0.25, "m"], [0.75, "l"]], "default": "none"}, "CASE WHEN opt IS NULL THEN 'none' WHEN opt < 0.25 THEN 's' WHEN opt < 0.75 THEN 'm' ELSE 'l' END", "false"),
    "f23_exponential": ({"property": "rank", "base": 2, "stops": [[0, 0], [4, 15]]}, "CASE WHEN rank <= 0 THEN 0 WHEN rank < 4 THEN 15 * (pow(2, rank) - 1) / 15 ELSE 15 END", "false"),
    "f23_zoom": ({"stops": [[5, 1], [9, 3]]}, "2.0", "false"),
    "f23_steps_of_texts": ({"property": "rank", "stops": [[0, "low"], [2, "high"]]}, "CASE WHEN rank < 2 THEN 'low' ELSE 'high' END", "false"),
    "f21_tokens": ("{name} of {brand}{gone} {", "concat(name, ' of ', brand, ' {')", "false"),
}


NUMBERS = ("f02_get", "f12_coalesce", "f16_interpolate", "f16_exponential", "f17_let", "f19_sum", "f20_number", "f23_exponential", "f23_zoom")


def features(spark, sf_dir):
    f = view(spark, sf_dir, "features")
    return f.withColumn("opt", F.when(F.col("feature_id") % 4 != 0, F.col("level")))


def register(name, rule, value, failed):
    number = "CASE WHEN {f} THEN NULL ELSE round(CAST({v} AS DOUBLE), 6) END" if name in NUMBERS else "CASE WHEN {f} THEN NULL ELSE {v} END"

    @query(name, FEATURES + f"SELECT feature_id, {number.format(v=value, f=failed)} AS v, {failed} AS failed FROM f")
    def run(spark, sf_dir):
        f = features(spark, sf_dir)
        out = compile_expression(rule, S.scope_of(f, PROPERTIES, F.lit(7.0)))
        v = F.round(out.value, 6) if out.kind == "number" else out.value
        return f.select("feature_id", F.when(~out.failed, v).alias("v"), out.failed.alias("failed"))


for _name, _rule in RULES.items():
    register(_name, *_rule)


@query("f22_legacy_filters", FEATURES + "SELECT feature_id, CASE WHEN geometry_type <> 'Point' THEN false WHEN brand IN ('Brand#1', 'Brand#4') THEN false ELSE opt >= 0.3 OR opt IS NULL AND false END IS TRUE AS hit, geometry_type = 'Point' AND brand NOT IN ('Brand#1', 'Brand#4') AND opt IS NULL AS failed FROM f")
def _(spark, sf_dir):
    f = features(spark, sf_dir)
    hit, failed = compile_filter(["all", ["==", "$type", "Point"], ["!in", "brand", "Brand#1", "Brand#4"], [">=", "opt", 0.3]], S.scope_of(f, PROPERTIES, F.lit(7.0)))
    return f.select("feature_id", hit.alias("hit"), failed.alias("failed"))


#: Colours in texts, and what they are in SQL: red, green, blue (multiplied by the opacity) and opacity, in thousandths.
COLORS = {"#f00": (1000, 0, 0, 1000), "#0f08": (0, 533, 0, 533), "#336699": (200, 400, 600, 1000), "#33669980": (100, 201, 301, 502), "rgb(255, 127.5, 0)": (1000, 500, 0, 1000), "RGBA(51,102,153,0.5)": (100, 200, 300, 500), "hsl(120, 100%, 50%)": (0, 1000, 0, 1000), "hsla(-120, 100%, 25%, 0.5)": (0, 0, 250, 500),
          "hsl(30, 50%, 40%)": (600, 400, 200, 1000), "#12345": None, "rgb(1,2)": None, "rgb(256,0,0)": None, "rgba(1,2,3)": None, "rgb(1,2,3,1)": None, "hsl(1,2,3)": None, "hsla(0,0%,0%,1.1)": None, "red": None}


@query("f24_parse_color", having("features") + "SELECT feature_id, CASE feature_id % 17 " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else list(v)}" for k, v in enumerate(COLORS.values())) + " END AS rgba FROM features")
def _(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t in COLORS]), (F.col("feature_id") % 17 + 1).cast("int"))
    c = parse_color(text)
    return view(spark, sf_dir, "features").select("feature_id", F.when(c.isNotNull(), F.array(*[F.round(c[k] * 1000).cast("int") for k in "rgba"])).alias("rgba"))


#: A small style, and the same in SQL.
LAYERS = [
    {"id": "roads", "type": "line", "source-layer": "road", "filter": [">", ["get", "opt"], 0.3], "paint": {"color": ["match", ["get", "rank"], 0, "#f00", "#00f"], "width": ["interpolate", ["linear"], ["zoom"], 5, 1, 9, 3]}},
    {"id": "hidden", "type": "line", "source-layer": "road", "visibility": "none"},
    {"id": "late", "type": "symbol", "source-layer": "poi", "minzoom": 9},
    {"id": "pois", "type": "symbol", "source-layer": "poi", "filter": ["!=", ["get", "rank"], 2], "paint": {"color": ["case", ["has", "opt"], "#111", "#222"]}},
    {"id": "land", "type": "fill", "source-layer": "landcover", "paint": {"color": "#0f0"}},
]
RESOLVED = FEATURES + """, r AS (SELECT feature_id, 0 AS layer_order, 'roads' AS layer_id, CASE WHEN opt IS NOT NULL THEN CASE WHEN rank = 0 THEN '#f00' ELSE '#00f' END END AS color, CASE WHEN opt IS NOT NULL THEN '2.0' END AS width, opt IS NULL AS failed FROM f WHERE source_layer = 'road' AND geometry_type = 'LineString' AND (opt > 0.3 OR opt IS NULL)
UNION ALL SELECT feature_id, 3, 'pois', CASE WHEN opt IS NOT NULL THEN '#111' ELSE '#222' END, NULL, false FROM f WHERE source_layer = 'poi' AND rank <> 2
UNION ALL SELECT feature_id, 4, 'land', '#0f0', NULL, false FROM f WHERE source_layer = 'landcover' AND geometry_type = 'Polygon')
"""


def resolved(spark, sf_dir):
    return S.resolve_layers(features(spark, sf_dir), LAYERS, 7.0, PROPERTIES)


@query("g01_resolve_layers", RESOLVED + "SELECT * FROM r")
def _(spark, sf_dir):
    return resolved(spark, sf_dir)


# Every source is drawn in the styles of its map (three sources, three styles), at the map's zoom.
@query("g01_resolve_styles", FEATURES.rstrip() + """, st AS (
  SELECT s_suppkey AS style_id, CAST(floor(s_suppkey / CAST(3 AS DOUBLE)) AS BIGINT) AS map_id, s_suppkey % 5 AS low, 5 + (1 + s_suppkey % 8) / 10.0 AS stop, 10 + s_suppkey % 4 AS high, s_suppkey % 3 <> 0 AS vis FROM supplier
), m AS (
  SELECT f.*, st.*, 5 + 1.5 * (st.map_id % 3) AS zoom FROM f JOIN st ON st.map_id = CAST(floor(f.source_id / CAST(3 AS DOUBLE)) AS BIGINT)
)
SELECT map_id, style_id, feature_id, 1 AS layer_order, 'roads' AS layer_id, '#f00' AS color, round(CASE WHEN zoom <= stop THEN 1 WHEN zoom < 9 THEN 1 + 2 * (zoom - stop) / (9 - stop) ELSE 3 END, 6) AS width, false AS failed
FROM m WHERE source_layer = 'road' AND geometry_type = 'LineString' AND zoom >= low AND opt IS NOT NULL
UNION ALL SELECT map_id, style_id, feature_id, 2, 'labels', NULL, NULL, false FROM m WHERE source_layer = 'poi' AND geometry_type = 'Point' AND zoom < high AND vis""")
def _(spark, sf_dir):
    map_of = lambda c: F.floor(F.col(c) / F.lit(3.0)).cast("long").alias("map_id")
    layers = read_style(view(spark, sf_dir, "styles"), keep=("style_id",)).withColumn("map_id", map_of("style_id"))
    f = features(spark, sf_dir).withColumn("map_id", map_of("source_id"))
    found = S.resolve_styles(f, layers, 5 + 1.5 * (F.col("map_id") % 3), PROPERTIES, ["map_id"])
    return found.select("map_id", "style_id", "feature_id", "layer_order", "layer_id", F.col("paint")["line-color"].alias("color"), F.round(F.col("paint")["line-width"].cast("double"), 6).alias("width"), "failed")


# More labels than are compared one by one: 50,000 names, every third of the parts' among them.
@query("f14_match_table", FEATURES + "SELECT feature_id, CASE WHEN feature_id % 3 = 0 AND feature_id < 150000 THEN 'third' WHEN rank = 1 THEN 'one' ELSE 'none' END AS v, CASE WHEN feature_id BETWEEN 1 AND 50000 THEN feature_id % 7 ELSE -1 END AS n FROM f")
def _(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("key", F.concat(F.lit("k"), F.col("feature_id")))
    scope = S.scope_of(f, [*PROPERTIES, "key", "feature_id"], F.lit(7.0))
    text = compile_expression(["match", ["get", "key"], [f"k{i}" for i in range(0, 150_000, 3)], "third", ["match", ["get", "rank"], 1, "one", "none"]], scope)
    number = compile_expression(["match", ["get", "feature_id"], *[x for r in range(7) for x in ([i for i in range(1, 50_001) if i % 7 == r], r)], -1], scope)
    return f.select("feature_id", text.value.alias("v"), number.value.cast("long").alias("n"))


@query("g01_failure_counts", RESOLVED + "SELECT layer_id, count(*) FILTER (NOT failed) AS n_drawn, count(*) FILTER (failed) AS n_failed FROM r GROUP BY layer_id")
def _(spark, sf_dir):
    return S.failure_counts(resolved(spark, sf_dir))


@query("g12_project_features", having("features") + f"SELECT feature_id, round((x + fx) / pow(2, z) * 360 - 180, 6) AS lon, round({LAT.format('(y + fy) / pow(2, z)')}, 6) AS lat FROM features")
def _(spark, sf_dir):
    return S.project_features(view(spark, sf_dir, "features")).select("feature_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


TEXTS = [{"id": "names", "type": "symbol", "source-layer": "poi", "filter": [">", ["get", "rank"], 0], "layout": {"text-field": "{name} {rank}"}}, {"id": "roads", "type": "symbol", "source-layer": "road", "layout": {"text-field": ["get", "brand"]}}, {"id": "off", "type": "symbol", "source-layer": "road", "visibility": "none", "layout": {"text-field": "x"}}, {"id": "bare", "type": "symbol", "source-layer": "road"}]


@query("g14_label_candidates", having("features") + """, t AS (
  SELECT source_id, z, x, y, 0 AS layer_order, 'names' AS layer_id, feature_id, concat(name, ' ', rank) AS text, fx AS ax, fy AS ay FROM features WHERE source_layer = 'poi' AND rank > 0
  UNION ALL SELECT source_id, z, x, y, 1, 'roads', feature_id, brand, fx + 0.02, fy FROM features WHERE source_layer = 'road'
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id, z, x, y ORDER BY layer_order, feature_id) AS INT) AS place FROM t WHERE trim(text) <> '')
SELECT source_id, z, x, y, place, layer_order, layer_id, feature_id, text, round(ax, 6) AS ax, round(ay, 6) AS ay FROM r WHERE place <= 256""")
def _(spark, sf_dir):
    f = features(spark, sf_dir)
    at = lambda dx: F.struct((F.col("fx") + dx).alias("x"), F.col("fy").alias("y"))
    line = F.when(F.col("geometry_type") == "LineString", F.array(F.array(at(0.0), at(0.01), at(0.02), at(0.03)))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))
    rows = S.label_candidates(f.withColumn("at", S.representative(F.array(at(0.0)), line)), TEXTS, 7.0, PROPERTIES)
    return rows.select("source_id", "z", "x", "y", "place", "layer_order", "layer_id", "feature_id", "text", F.round("at.x", 6).alias("ax"), F.round("at.y", 6).alias("ay"))
