"""Views of map data over the given tables. The texts are SQL that both Spark and the oracle's engine run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: A world grid of 400 x 250 points, by an index from 0 to 99999.
LON = "CAST(-179.5 AS DOUBLE) + ({i} % 400) * (CAST(359 AS DOUBLE) / CAST(399 AS DOUBLE))"
LAT = "CAST(-80 AS DOUBLE) + (CAST(floor({i} / CAST(400 AS DOUBLE)) AS BIGINT) % 250) * (CAST(160 AS DOUBLE) / CAST(249 AS DOUBLE))"


def _grid(i: str) -> str:
    return f"{LON.format(i=i)} AS lon, {LAT.format(i=i)} AS lat"


VIEWS: dict[str, str] = {
    "points": f"SELECT event_id AS point_id, user_id AS device, ts, value, event_type AS kind, {_grid('((event_id * 7919) % 100000)')} FROM events",
    "scenes": f"""SELECT o_orderkey AS scene_id, o_orderkey % (SELECT 1 + CAST(floor(max(s_suppkey) / CAST(3 AS DOUBLE)) AS BIGINT) FROM supplier) AS map_id, CAST(2 + o_orderkey % 9 + (o_orderkey % 4) * 0.25 AS DOUBLE) AS zoom,
        CAST(1024 AS DOUBLE) AS vw, CAST(768 AS DOUBLE) AS vh, CAST((o_orderkey % 8) * 45 AS DOUBLE) AS heading, CAST((o_orderkey % 3) * 20 AS DOUBLE) AS pitch, o_orderdate AS ts, {_grid('((o_orderkey * 7919) % 100000)')} FROM orders""",
    "layers": """SELECT s_suppkey AS source_id, CAST(floor(s_suppkey / CAST(3 AS DOUBLE)) AS BIGINT) AS map_id, CAST(s_suppkey % 4 AS DOUBLE) AS min_zoom, CAST(6 + s_suppkey % 5 AS DOUBLE) AS max_zoom, s_suppkey % 7 <> 6 AS is_visible,
        CAST(CASE WHEN s_suppkey % 5 = 4 THEN 0 ELSE 1 END AS DOUBLE) AS opacity, CAST(s_suppkey % 3 AS INT) AS min_source_zoom, CAST(5 + s_suppkey % 4 AS INT) AS max_source_zoom,
        CAST(CASE WHEN s_suppkey % 2 = 0 THEN 256 ELSE 512 END AS INT) AS tile_size, CAST(-180 + (s_suppkey % 18) * 10 AS DOUBLE) AS west, CAST(-80 AS DOUBLE) AS south,
        CAST(180 - (s_suppkey % 18) * 5 AS DOUBLE) AS east, CAST(80 - s_suppkey % 40 AS DOUBLE) AS north FROM supplier""",
    "tile_cache": """SELECT source_id, z, x, y, CAST(sum(q) * 1024 AS BIGINT) AS bytes, max(d) AS last_used, CASE WHEN max(s) = 'F' THEN 'F' ELSE 'O' END AS status FROM (
        SELECT l_suppkey AS source_id, CAST(3 + l_linenumber % 4 AS INT) AS z,
        CAST(l_partkey % CASE l_linenumber % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 64 END AS INT) AS x,
        CAST(l_orderkey % CASE l_linenumber % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 64 END AS INT) AS y, l_quantity AS q, l_shipdate AS d, l_linestatus AS s FROM lineitem) GROUP BY source_id, z, x, y""",
    "tile_events": """SELECT l_suppkey AS source_id, CAST(l_linenumber AS BIGINT) AS generation, l_orderkey % 50 AS scene_version, CAST(3 + l_linenumber % 4 AS INT) AS z,
        CAST(l_partkey % 8 AS INT) AS x, CAST(l_orderkey % 8 AS INT) AS y, l_shipdate AS ts, CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'failed' ELSE 'cancelled' END AS state,
        CAST(CASE l_linenumber % 5 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 404 ELSE 500 END AS INT) AS status_code, l_quantity AS download_ms, l_tax * 100 AS decode_ms, l_quantity + l_tax * 100 + l_discount * 100 AS total_ms FROM lineitem""",
    "elements": f"""SELECT c_custkey AS element_id, CAST(c_custkey % 5 AS INT) AS layer_index, CAST(c_custkey % 11 AS INT) AS collection_index, c_nationkey AS z_index, c_custkey % 13 <> 0 AS is_visible, c_custkey % 17 <> 0 AS is_enabled,
        CAST(16 + c_custkey % 32 AS DOUBLE) AS width, CAST(16 + c_custkey % 24 AS DOUBLE) AS height, CAST(0.5 AS DOUBLE) AS anchor_x, CAST(1 AS DOUBLE) AS anchor_y, CAST(c_custkey % 37 AS INT) AS texture_id, {_grid('((c_custkey * 7919) % 100000)')} FROM customer""",
    "tracks": """SELECT user_id AS path_id, CAST(floor((i - 1) / CAST(4096 AS DOUBLE)) AS INT) AS contour, i, lon0 - 360 * floor((lon0 + 180) / 360) AS lon, lat FROM (
        SELECT user_id, i, CAST((user_id * 37) % 360 - 180 AS DOUBLE) + 0.37 * CAST(i AS DOUBLE) AS lon0, -60 + CAST((user_id * 13) % 120 AS DOUBLE) + 0.21 * CAST(event_id % 10 AS DOUBLE) AS lat FROM (
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events))""",
    # A box for each customer, the even ones with a hole.
    "polygons": f"""SELECT shape_id, contour, CASE WHEN contour = 0 THEN i ELSE 3 - i END AS i, lon + sx * CASE WHEN contour = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS lon, lat + sy * CASE WHEN contour = 0 THEN CAST(1.25 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS lat, fill_alpha, order_index, is_visible, is_enabled FROM (
        SELECT c_custkey AS shape_id, contour, i, CASE WHEN i = 0 OR i = 3 THEN -1 ELSE 1 END AS sx, CASE WHEN i < 2 THEN -1 ELSE 1 END AS sy, CAST(c_custkey % 3 AS INT) AS fill_alpha, c_custkey * 2 AS order_index, c_custkey % 13 <> 0 AS is_visible, c_custkey % 17 <> 0 AS is_enabled, {_grid('((c_custkey * 2503) % 100000)')} FROM (
        SELECT c_custkey, CAST(floor(k / CAST(4 AS DOUBLE)) AS INT) AS contour, CAST(k % 4 AS INT) AS i FROM customer CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS corners(k)))
        WHERE contour = 0 OR shape_id % 2 = 0""",
    # Twenty features a tile, and two sources for each tile's number: tiles grow in number with the parts, over zooms from 4 to 14.
    "features": """SELECT 1 + p_partkey % 2 + 2 * CAST(floor(t / CAST(256 AS DOUBLE)) AS BIGINT) AS source_id, CAST(4 + t % 11 AS INT) AS z, CAST((t * 7919) % CAST(pow(2, 4 + t % 11) AS BIGINT) AS INT) AS x, CAST((t * 104729 + 3) % CAST(pow(2, 4 + t % 11) AS BIGINT) AS INT) AS y, p_partkey AS feature_id,
        CASE p_type WHEN 'ECONOMY' THEN 'road' WHEN 'SMALL' THEN 'poi' WHEN 'MEDIUM' THEN 'water_label' WHEN 'PROMO' THEN 'transit' WHEN 'STANDARD' THEN 'admin_boundary' ELSE 'landcover' END AS source_layer,
        CASE WHEN p_type = 'ECONOMY' THEN 'LineString' WHEN p_type = 'LARGE' THEN 'Polygon' ELSE 'Point' END AS geometry_type,
        CAST((p_partkey * 31) % 97 AS DOUBLE) / 97 AS fx, CAST((p_partkey * 17) % 89 AS DOUBLE) / 89 AS fy, p_name AS name, CAST(p_partkey % 5 AS INT) AS rank, p_size / CAST(50 AS DOUBLE) AS level, p_brand AS brand, p_retailprice AS height FROM (SELECT *, CAST(floor(p_partkey / CAST(40 AS DOUBLE)) AS BIGINT) AS t FROM part)""",
    # A scene for each supplier: its lines are symbols, an icon and a text each.
    "placements": """SELECT scene_id, symbol_group, placement_index, style_order, sort_key, x0 AS "left", y0 AS top, width, height, rotation, padding, CASE WHEN k = 0 THEN 'icon' ELSE 'text' END AS kind, optional, allow_overlap, ignore_placement, placement_index * 2 + k AS seq FROM (
        SELECT l_suppkey AS scene_id, l_partkey AS symbol_group, n AS placement_index, CAST(l_partkey % 4 AS INT) AS style_order, CAST(l_quantity AS DOUBLE) AS sort_key, CAST((l_partkey * 137 + n * 31) % 1900 AS DOUBLE) AS x0, CAST((l_partkey * 89 + n * 17) % 1060 AS DOUBLE) AS y0,
        CAST(20 + l_partkey % 60 AS DOUBLE) AS width, CAST(12 + l_partkey % 8 AS DOUBLE) AS height, CAST((l_partkey % 4) * 30 AS DOUBLE) AS rotation, CAST(l_partkey % 3 AS DOUBLE) AS padding, l_partkey % 6 = 0 AS optional, l_partkey % 11 = 0 AS allow_overlap, l_partkey % 13 = 0 AS ignore_placement, k FROM (
        SELECT l_suppkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice) AS n FROM lineitem) CROSS JOIN (VALUES (0), (1)) AS parts(k))""",
    "pointer_events": "SELECT user_id % 20 AS pointer_id, event_id, ts, CASE WHEN event_type <> 'error' THEN CAST(floor(value / 50) AS BIGINT) END AS target FROM events",
    # A style in JSON for each supplier; braces are written as < and >.
    "styles": """SELECT s_suppkey AS style_id, replace(replace(concat('<"version":8,"layers":[<"id":"bg","type":"background","paint":<"background-color":"#fff","background-pattern":"x">>,',
        '<"id":"roads","type":"line","source":"base","source-layer":"road","minzoom":', CAST(s_suppkey % 5 AS VARCHAR(9)), ',"filter":["has","opt"],"layout":<"line-cap":"round","line-strange":1>,"paint":<"line-color":"#f00","line-width":<"stops":[[5.', CAST(1 + s_suppkey % 8 AS VARCHAR(9)), ',1],[9,3]]>>>,',
        '<"id":"labels","type":"symbol","source-layer":"poi","maxzoom":', CAST(10 + s_suppkey % 4 AS VARCHAR(9)), ',"layout":<"visibility":"', CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE 'visible' END, '","text-field":"<name>","symbol-avoid-edges":true>>,',
        '<"id":"heat","type":"heatmap">,<"id":"odd","type":"', CASE WHEN s_suppkey % 2 = 0 THEN 'strange' ELSE 'circle' END, '">]>'), '<', chr(123)), '>', chr(125)) AS json FROM supplier""",
    "services": """SELECT s_suppkey AS service_id, replace(replace(concat('<"tiles":["t/', CAST(s_suppkey AS VARCHAR(20)), '"],"defaultStyles":"s","tileInfo":<"rows":512,"cols":', CASE WHEN s_suppkey % 7 = 0 THEN '256' ELSE '512' END,
        ',"lods":[', CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE concat('<"level":', CAST(3 + s_suppkey % 4 AS VARCHAR(9)), '>,<"level":', CAST(s_suppkey % 3 AS VARCHAR(9)), '>') END, ']>', CASE WHEN s_suppkey % 2 = 0 THEN ',"copyrightText":"Someone"' ELSE ',"copyrightText":" "' END, '>'), '<', chr(123)), '>', chr(125)) AS json FROM supplier""",
    # Shapes of tile features, in whole numbers of a grid of 4096: a point, a line of three points, or a square with a hole for every other one.
    "shaped": """SELECT source_id, z, x, y, feature_id, source_layer, geometry_type, name, rank, level, CAST((feature_id * 31) % 3000 AS BIGINT) AS gx, CAST((feature_id * 17) % 3000 AS BIGINT) AS gy FROM features""",
    "places": f"""SELECT place_id, name, address, {_grid('(((place_id - place_id % 2) * 7919) % 100000)')}, entity_type FROM (
        SELECT c_custkey AS place_id, c_name AS name, c_mktsegment AS address, CASE c_nationkey % 4 WHEN 0 THEN 'Country' WHEN 1 THEN 'Municipality' WHEN 2 THEN 'POI' ELSE 'Street' END AS entity_type FROM customer
        UNION ALL SELECT 1000000 + s_suppkey AS place_id, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END AS name, 'Supplier row' AS address, 'POI' AS entity_type FROM supplier)""",
    "favorite_events": "SELECT event_id AS seq, user_id, CASE WHEN event_type = 'click' THEN 'toggle' WHEN event_type = 'view' THEN 'rename' END AS action, user_id % 40 AS place_id, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE concat(' name', CAST(event_id AS VARCHAR(20)), ' ') END AS new_name FROM events WHERE event_type IN ('click', 'view')",
    "route_legs": f"""SELECT l_orderkey AS route_id, idx, CAST(floor((idx - 1) / CAST(3 AS DOUBLE)) AS BIGINT) AS leg, CASE WHEN l_linenumber <> 4 THEN idx * 120 + l_linenumber END AS offset_m, {_grid('(((l_orderkey * 13 + idx) * 7) % 100000)')} FROM (
        SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS idx FROM lineitem)""",
    "incidents": f"""SELECT event_id AS incident_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 17 AS category, CAST(event_id % 5 AS INT) AS magnitude, value AS delay_s, event_type AS description, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN ' closed ' END AS description_0, {_grid('((event_id * 7919) % 100000)')} FROM events""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS, or one of the tables, over the files in sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, frames = VIEWS[name].replace('"left"', "`left`"), {}
    for t in (*TABLES, *VIEWS):
        if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
            frames[t] = view(spark, sf_dir, t)
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)


def having(*names: str) -> str:
    """The beginning of an oracle's text: WITH the named views, and those that they stand on."""
    wanted = {v for n in names for v in (n, *(o for o in VIEWS if re.search(rf"\b(FROM|JOIN) {o}\b", VIEWS[n])))}
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in VIEWS.items() if n in wanted) + "\n"
