"""Queries of the feature and label jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.jobs.fixtures import having, view
from tilewright.jobs.registry import query
from tilewright.operators import labels as L

C = F.col


@query("g08_classify_feature", having("features") + "SELECT feature_id, CASE source_layer WHEN 'road' THEN 'Road' WHEN 'transit' THEN 'Transit' WHEN 'water_label' THEN 'Water' WHEN 'landcover' THEN 'NaturalFeature' WHEN 'poi' THEN 'Landmark' ELSE 'AdministrativeArea' END AS kind FROM features")
def _(spark, sf_dir):
    return view(spark, sf_dir, "features").select("feature_id", L.classify_feature(C("source_layer")).alias("kind"))


CAND = having("features") + """, cd AS (SELECT x AS scene, name, rank AS layer_order, level AS prominence, feature_id AS seq, fx + fy AS distance FROM features),
nm AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY scene, name ORDER BY layer_order DESC, prominence DESC, seq) AS r FROM cd) WHERE r = 1),
tp AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scene ORDER BY layer_order DESC, prominence DESC, distance, seq) AS INT) AS rank FROM nm) WHERE rank <= 8)
"""


def named(spark, sf_dir):
    f = view(spark, sf_dir, "features").select(C("x").alias("scene"), "name", C("rank").alias("layer_order"), C("level").alias("prominence"), C("feature_id").alias("seq"), (C("fx") + C("fy")).alias("distance"))
    return L.dedupe_named(f, ["scene"], ["distance"])


@query("g09_dedupe_named_features", CAND + "SELECT scene, name, layer_order, round(prominence, 6) AS prominence, seq, round(distance, 6) AS distance FROM nm")
def _(spark, sf_dir):
    return named(spark, sf_dir).select("scene", "name", "layer_order", F.round("prominence", 6).alias("prominence"), "seq", F.round("distance", 6).alias("distance"))


@query("g10_top_features", CAND + "SELECT scene, rank, name, seq FROM tp")
def _(spark, sf_dir):
    return L.top_features(named(spark, sf_dir), ["scene"]).select("scene", "rank", "name", "seq")


@query("g11_describe", CAND + ", l AS (SELECT scene, list(trim(name) ORDER BY rank) FILTER (trim(name) <> '') AS n FROM tp WHERE rank <= 5 GROUP BY scene) SELECT scene, CASE WHEN len(n) = 1 THEN n[1] ELSE concat(array_to_string(n[1:len(n) - 1], ', '), ' and ', n[len(n)]) END AS text FROM l")
def _(spark, sf_dir):
    return L.describe(L.top_features(named(spark, sf_dir), ["scene"]), ["scene"])


BOX = having("placements") + """, bx AS (SELECT *, "left" + width / 2 - (abs(cos(radians(rotation))) * width + abs(sin(radians(rotation))) * height) / 2 AS x0, top + height / 2 - (abs(sin(radians(rotation))) * width + abs(cos(radians(rotation))) * height) / 2 AS y0,
"left" + width / 2 + (abs(cos(radians(rotation))) * width + abs(sin(radians(rotation))) * height) / 2 AS x1, top + height / 2 + (abs(sin(radians(rotation))) * width + abs(cos(radians(rotation))) * height) / 2 AS y1 FROM placements),
gr AS (SELECT *, CASE WHEN max(CAST(optional AS INT)) OVER w = 0 THEN 0 WHEN kind = 'icon' THEN 1 ELSE 2 END AS component, min(seq) OVER w AS family FROM bx WINDOW w AS (PARTITION BY scene_id, symbol_group, placement_index))
"""


@query("h01_symbol_bounds", BOX + "SELECT scene_id, seq, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM bx")
def _(spark, sf_dir):
    p = view(spark, sf_dir, "placements")
    b = L.symbol_bounds(*[C(c) for c in ("left", "top", "width", "height", "rotation")])
    return p.select("scene_id", "seq", *[F.round(v, 4).alias(k) for k, v in b.items()])


@query("h02_collision_groups", BOX + "SELECT scene_id, seq, component, family FROM gr")
def _(spark, sf_dir):
    return L.collision_groups(view(spark, sf_dir, "placements")).select("scene_id", "seq", "component", "family")


@query("h03_collision_candidates", BOX + """
SELECT scene_id, symbol_group, placement_index, component, min(family) AS family, arg_min(style_order, seq) AS style_order, round(min(x0), 4) AS x0, round(min(y0), 4) AS y0, round(max(x1), 4) AS x1, round(max(y1), 4) AS y1, min(sort_key) AS sort_key,
  max(padding) AS padding, bool_and(allow_overlap) AS allow_overlap, bool_and(ignore_placement) AS ignore_placement, count(*) FILTER (kind = 'text') AS n_glyphs, min(seq) AS seq
FROM gr GROUP BY scene_id, symbol_group, placement_index, component""")
def _(spark, sf_dir):
    c = L.collision_candidates(L.collision_groups(view(spark, sf_dir, "placements")))
    return c.withColumns({k: F.round(k, 4) for k in ("x0", "y0", "x1", "y1")})


# Candidates are placed one after the other: a text of ones and zeros says which were accepted so far.
@query("h04_resolve_collisions", BOX + """, c AS (
  SELECT scene_id, symbol_group, placement_index, component, min(family) AS family, arg_min(style_order, seq) AS style_order, min(x0) - max(padding) AS l, min(y0) - max(padding) AS t, max(x1) + max(padding) AS r, max(y1) + max(padding) AS b,
    min(sort_key) AS sort_key, bool_and(allow_overlap) AS allow_overlap, bool_and(ignore_placement) AS ignore_placement, min(seq) AS seq FROM gr GROUP BY scene_id, symbol_group, placement_index, component
), o AS (
  SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY style_order DESC, sort_key, seq) AS n FROM c
), k AS (
  SELECT v.scene_id, v.n, list(u.n) AS blockers FROM o u JOIN o v ON u.scene_id = v.scene_id AND u.n < v.n AND u.family <> v.family AND NOT u.ignore_placement AND NOT v.allow_overlap
    AND u.l < v.r AND u.r > v.l AND u.t < v.b AND u.b > v.t GROUP BY v.scene_id, v.n
), w AS (
  SELECT scene_id, list_reduce(list_prepend({'placed': '', 'blockers': CAST([] AS BIGINT[])}, list({'placed': '', 'blockers': coalesce(blockers, [])} ORDER BY o.n)),
    lambda a, x: {'placed': a.placed || CASE WHEN len(list_filter(x.blockers, lambda y: substr(a.placed, y, 1) = '1')) > 0 THEN '0' ELSE '1' END, 'blockers': x.blockers}).placed AS placed
  FROM o LEFT JOIN k USING (scene_id, n) GROUP BY scene_id
)
SELECT o.scene_id, symbol_group, placement_index, component, substr(w.placed, o.n, 1) = '1' AS accepted FROM o JOIN w ON w.scene_id = o.scene_id""")
def _(spark, sf_dir):
    return L.resolve_collisions(L.collision_candidates(L.collision_groups(view(spark, sf_dir, "placements")))).select("scene_id", "symbol_group", "placement_index", "component", "accepted")


@query("h06_batch_runs", having("placements") + ", l AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND kind = lag(kind) OVER w AND padding = lag(padding) OVER w THEN 0 ELSE 1 END AS s FROM placements WINDOW w AS (PARTITION BY scene_id ORDER BY style_order, sort_key, seq)) SELECT scene_id, seq, CAST(sum(s) OVER (PARTITION BY scene_id ORDER BY style_order, sort_key, seq) AS BIGINT) AS batch FROM l")
def _(spark, sf_dir):
    return L.batch_runs(view(spark, sf_dir, "placements"), ["kind", "padding"]).select("scene_id", "seq", "batch")


@query("h07_element_order", having("elements") + "SELECT element_id, layer_index, row_number() OVER (ORDER BY layer_index, z_index, collection_index, element_id) - 1 AS draw_order FROM elements WHERE is_visible")
def _(spark, sf_dir):
    return L.element_order(view(spark, sf_dir, "elements")).select("element_id", "layer_index", "draw_order")


@query("h08_layer_summary", having("elements") + "SELECT layer_index, count(*) AS n_elements, count(*) FILTER (is_visible) AS n_visible, count(DISTINCT texture_id) AS n_textures FROM elements GROUP BY layer_index")
def _(spark, sf_dir):
    return L.layer_summary(view(spark, sf_dir, "elements"))


@query("h09_validate_batch", having("elements") + ", b AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey * 3 END AS element_id FROM lineitem), n AS (SELECT element_id, count(*) AS n FROM b GROUP BY 1) SELECT element_id, n, CASE WHEN element_id IS NULL THEN 'null' WHEN n > 1 THEN 'repeated' WHEN element_id IN (SELECT element_id FROM elements) THEN 'present' ELSE 'ok' END AS reason FROM n")
def _(spark, sf_dir):
    b = view(spark, sf_dir, "lineitem").select(F.when(C("l_partkey") % 50 != 0, C("l_partkey") * 3).alias("element_id"))
    return L.validate_batch(b, view(spark, sf_dir, "elements"))


@query("h11_symbol_stats", having("placements") + "SELECT scene_id, style_order, count(*) FILTER (kind = 'icon') AS n_icons, count(*) FILTER (kind <> 'icon') AS n_texts, count(*) FILTER (rotation <> 0) AS n_rotated, count(*) FILTER (sort_key <> 0) AS n_sorted, count(*) FILTER (allow_overlap OR ignore_placement) AS n_override FROM placements GROUP BY ALL")
def _(spark, sf_dir):
    return L.symbol_stats(view(spark, sf_dir, "placements"))
