"""Queries of the traffic, place, route and event jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import mercator as M
from tilewright.jobs.fixtures import having, view
from tilewright.jobs.q_tiles import HAV
from tilewright.jobs.registry import query
from tilewright.operators import places as P
from tilewright.operators import telemetry as E
from tilewright.operators import traffic as T

C = F.col

FLOW = having("features") + """, f AS (SELECT feature_id, CASE WHEN feature_id % 7 <> 0 THEN level END AS lv, feature_id % 11 = 0 AS shut, feature_id % 3 = 0 AS one, feature_id % 2 = 0 AS lft, CAST(4 + feature_id % 17 AS DOUBLE) AS zm FROM features),
g AS (SELECT *, CASE WHEN shut THEN '#8b1e2d' WHEN lv IS NULL THEN '#808080' WHEN lv >= 1 THEN '#27864a' WHEN lv >= 0.85 THEN '#e6c229' WHEN lv >= 0.6 THEN '#ef7d22' WHEN lv >= 0.01 THEN '#d73027' ELSE '#8b1e2d' END AS c,
CASE WHEN zm < 5 THEN 1.5 WHEN zm < 12 THEN 1.5 + 1.5 * (zm - 5) / 7 WHEN zm < 18 THEN 3 + 3 * (zm - 12) / 6 ELSE 6 END AS w FROM f)
"""


def flow(spark, sf_dir, mode):
    f = view(spark, sf_dir, "features")
    i = C("feature_id")
    f = f.select("feature_id", F.when(i % 7 != 0, C("level")).alias("traffic_level"), (i % 11 == 0).alias("road_closure"), (i % 3 == 0).alias("one_side"), (i % 2 == 0).alias("left_hand"), (4 + i % 17).cast("double").alias("zoom"))
    return T.flow_class(f, mode).select("feature_id", "flow_color", F.round("flow_width", 6).alias("flow_width"), F.round("flow_offset", 6).alias("flow_offset"))


FLOW_SELECT = "SELECT feature_id, c AS flow_color, round(w, 6) AS flow_width, round(CASE WHEN one THEN CASE WHEN lft THEN -1 ELSE 1 END * w / 2 ELSE 0 END, 6) AS flow_offset FROM g"


@query("j01_traffic_flow", FLOW + FLOW_SELECT)
def _(spark, sf_dir):
    return flow(spark, sf_dir, "relative")


@query("j01_traffic_flow_delay", FLOW + FLOW_SELECT + " WHERE shut OR lv < 1")
def _(spark, sf_dir):
    return flow(spark, sf_dir, "delay")


NAMES = "['warning','accident','fog','danger','rain','ice','congestion','lane-closed','road-closed','roadworks','wind','flooding','detour','cluster','breakdown']"


@query("j02_incident_icon", having("incidents") + f"SELECT incident_id, concat(CASE WHEN category BETWEEN 0 AND 14 THEN {NAMES}[category + 1] ELSE 'warning' END, CASE WHEN magnitude = 3 THEN '-major' ELSE '' END) AS icon FROM incidents")
def _(spark, sf_dir):
    return view(spark, sf_dir, "incidents").select("incident_id", T.incident_icon(C("category"), C("magnitude")).alias("icon"))


@query("j03_normalize_incidents", having("incidents") + """SELECT incident_id, nullif(CASE WHEN description_0 IS NULL OR trim(description_0) = trim(description) THEN trim(description) ELSE concat(trim(description), '; ', trim(description_0)) END, '') AS descriptions,
CASE WHEN delay_s - 100 >= 0 THEN round(delay_s - 100, 4) END AS delay_s, CASE WHEN delay_s = floor(delay_s) THEN CAST(delay_s AS INT) END AS code, CASE WHEN incident_id % 3 = 0 THEN TIMESTAMP '2024-05-06 05:08:09' WHEN incident_id % 3 = 1 THEN TIMESTAMP '2024-05-06 07:08:09' END AS start_time FROM incidents""")
def _(spark, sf_dir):
    start = F.when(C("incident_id") % 3 == 0, "2024-05-06T07:08:09+02:00").when(C("incident_id") % 3 == 1, " 2024-05-06T07:08:09Z ").otherwise("2024-05-06T07:08:09")
    return view(spark, sf_dir, "incidents").select("incident_id", T.joined_descriptions([C("description"), C("description_0")]).alias("descriptions"), F.round(T.delay_seconds(C("delay_s") - 100), 4).alias("delay_s"), T.whole_code(C("delay_s")).alias("code"), T.explicit_time(start).alias("start_time"))


@query("j04_incident_visible", having("scenes") + "SELECT scene_id, zoom >= 8 AS visible FROM scenes")
def _(spark, sf_dir):
    return view(spark, sf_dir, "scenes").select("scene_id", T.incident_visible(C("zoom"), 8).alias("visible"))


@query("j05_weather_frame", "SELECT event_id, make_timestamp((epoch_us(ts) + 150000000) // 300000000 * 300000000) AS radar, make_timestamp((epoch_us(ts) + 300000000) // 600000000 * 600000000) AS infrared FROM events")
def _(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", T.weather_frame(C("ts"), "radar").alias("radar"), T.weather_frame(C("ts"), "infrared").alias("infrared"))


@query("j06_refresh_version", "SELECT event_id, epoch_us(ts) // 60000000 AS version, round((300000000 - epoch_us(ts) % 300000000) / 1000000.0, 6) AS delay_s FROM events")
def _(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", T.refresh_version(C("ts"), 60).alias("version"), F.round(T.refresh_delay(C("ts"), 300), 6).alias("delay_s"))


# Named characters as a map; a text falls into entities, other ampersands and what lies between.
NAMED = "MAP {" + ", ".join(f"'{name}': chr({ord(c)})" for name, c in T.ENTITIES.items()) + "}"
CODE = "CAST(CASE WHEN lower(e[3]) = 'x' THEN concat('0x', e[4:-2]) ELSE e[3:-2] END AS BIGINT)"


@query("j07_attribution", rf"""WITH t AS (SELECT page_id % 20 AS layer, page_id AS seq, regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '<[^>]+>', '', 'g') AS x FROM pages),
e AS (SELECT layer, seq, unnest(regexp_extract_all(x, '&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z0-9]+);|&|[^&]+')) AS e, generate_subscripts(regexp_extract_all(x, '&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z0-9]+);|&|[^&]+'), 1) AS k FROM t),
d AS (SELECT layer, seq, k, CASE WHEN e[1] <> '&' OR e = '&' THEN e WHEN e[2] <> '#' THEN coalesce({NAMED}[e[2:-2]], e) WHEN {CODE} < 55296 OR {CODE} BETWEEN 57344 AND 1114111 THEN chr(CAST({CODE} AS INT)) ELSE e END AS e FROM e),
u AS (SELECT layer, seq, trim(string_agg(e, '' ORDER BY k)) AS text FROM d GROUP BY ALL), f AS (SELECT layer, text, min(seq) AS seq FROM u WHERE text <> '' GROUP BY ALL) SELECT layer, string_agg(text, ' ' ORDER BY seq) AS attribution FROM f GROUP BY layer""")
def _(spark, sf_dir):
    t = view(spark, sf_dir, "pages").select((C("page_id") % 20).alias("layer"), C("page_id").alias("seq"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("text"))
    return T.attribution(T.plain_text(t, "text"))


@query("j08_is_category", "WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS query FROM part), t AS (SELECT DISTINCT upper(p_name) AS term FROM part WHERE p_partkey % 5 = 0) SELECT query, EXISTS (SELECT 1 FROM t WHERE lower(strip_accents(term)) = lower(strip_accents(query)) OR starts_with(lower(strip_accents(term)), concat(lower(strip_accents(query)), ' '))) AS is_category FROM q")
def _(spark, sf_dir):
    p = view(spark, sf_dir, "part")
    return P.is_category(p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("query")).distinct(), p.filter("p_partkey % 5 = 0").select(F.upper("p_name").alias("term")))


@query("j10_filter_places", having("places") + f"SELECT place_id, CASE WHEN name = '' THEN address ELSE name END AS name FROM places WHERE CASE WHEN place_id % 3 = 0 THEN lower(address) = 'building' ELSE entity_type <> 'POI' OR {HAV.format('lat', 'lon', '10.0', '20.0')} <= 5000000 END")
def _(spark, sf_dir):
    p = view(spark, sf_dir, "places")
    return P.filter_places(p, C("place_id") % 3 == 0, F.lower("address") == "building", F.lit(10.0), F.lit(20.0), 5_000_000).select("place_id", "name")


@query("j11_search_area", having("scenes") + f", c AS (SELECT scene_id, lat, lon, lat + d AS clat, lon + e AS clon FROM (SELECT * FROM scenes), (VALUES (0.1, 0.2), (-0.1, 0.3), (0.05, -0.2), (-0.02, -0.1)) AS t(d, e)) SELECT scene_id, CAST(least(greatest(ceil(max({HAV.format('lat', 'lon', 'clat', 'clon')} * 1.25)), 1000), 50000) AS INT) AS radius_m FROM c GROUP BY scene_id")
def _(spark, sf_dir):
    corners = F.array(*[F.struct((C("lat") + d).alias("a"), (C("lon") + e).alias("o")) for d, e in ((0.1, 0.2), (-0.1, 0.3), (0.05, -0.2), (-0.02, -0.1))])
    rows = view(spark, sf_dir, "scenes").select("scene_id", "lat", "lon", F.explode(corners).alias("k")).select("scene_id", "lat", "lon", C("k.a").alias("corner_lat"), C("k.o").alias("corner_lon"))
    return P.search_area(rows)


@query("j14_dedupe_places", having("places") + "SELECT place_id, name, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY place_id) AS r FROM places) WHERE r = 1")
def _(spark, sf_dir):
    return P.first_at_place(view(spark, sf_dir, "places"), ["place_id"]).select("place_id", "name", "lat", "lon")


@query("j15_favorite_events", having("favorite_events") + """, t AS (SELECT *, sum(CASE WHEN action = 'toggle' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, place_id ORDER BY seq) AS t FROM favorite_events),
n AS (SELECT user_id, place_id, max(t) AS n FROM t GROUP BY ALL), l AS (SELECT t.user_id, t.place_id, arg_max(trim(new_name), seq) AS name FROM t JOIN n ON n.user_id = t.user_id AND n.place_id = t.place_id AND t.t = n.n WHERE action = 'rename' AND trim(new_name) <> '' GROUP BY ALL)
SELECT n.user_id, n.place_id, l.name FROM n LEFT JOIN l ON l.user_id = n.user_id AND l.place_id = n.place_id WHERE n % 2 = 1""")
def _(spark, sf_dir):
    return P.apply_favorite_events(view(spark, sf_dir, "favorite_events"))


@query("j16_route_points", having("route_legs") + "SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY leg, idx) - 1 AS point_index, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT *, count(*) OVER (PARTITION BY route_id) AS n FROM route_legs) WHERE n >= 2")
def _(spark, sf_dir):
    return P.route_points(view(spark, sf_dir, "route_legs")).select("route_id", C("point_index").cast("long").alias("point_index"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("j17_route_steps", having("route_legs") + """, p AS (SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY leg, idx) - 1 AS pi, lat, lon FROM (SELECT *, count(*) OVER (PARTITION BY route_id) AS n FROM route_legs) WHERE n >= 2),
i AS (SELECT route_id, idx AS seq, idx * 2 - 2 AS pi, offset_m, coalesce(last_value(offset_m IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM route_legs)
SELECT i.route_id, seq, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN offset_m IS NOT NULL THEN greatest(0, offset_m - b) END AS metres, lat IS NULL AS error FROM i LEFT JOIN p ON p.route_id = i.route_id AND p.pi = i.pi""")
def _(spark, sf_dir):
    legs = view(spark, sf_dir, "route_legs")
    steps = legs.select("route_id", C("idx").alias("seq"), (C("idx") * 2 - 2).alias("point_index"), "offset_m")
    return P.route_steps(steps, P.route_points(legs)).withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@query("j18_format_distance", """SELECT event_id, CASE
  WHEN m < 1000 THEN concat(format('{:,}', CAST(round(m) AS BIGINT)), ' m') ELSE concat(format('{:,}', CAST(floor(round(m / 1000, 1)) AS BIGINT)), '.', CAST(round(round(m / 1000, 1) * 10) AS BIGINT) % 10, ' km') END AS metric, CASE
  WHEN m * 3.280839895 < 528 THEN concat(format('{:,}', CAST(round(m * 3.280839895) AS BIGINT)), ' ft') ELSE concat(format('{:,}', CAST(floor(round(m / 1609.344, 1)) AS BIGINT)), '.', CAST(round(round(m / 1609.344, 1) * 10) AS BIGINT) % 10, ' mi') END AS imperial
  FROM (SELECT event_id, value * value * value / 50 AS m
  FROM events)""")
def _(spark, sf_dir):
    m = C("value") * C("value") * C("value") / 50
    return view(spark, sf_dir, "events").select("event_id", P.format_distance(m).alias("metric"), P.format_distance(m, False).alias("imperial"))


MOVES = ("TURN_LEFT", "turn_right", "ROUNDABOUT_RIGHT", "ROUNDABOUT_BACK", "MAKE_UTURN", "MERGE_LEFT", "EXIT_RIGHT", "TAKE_EXIT_LEFT", "KEEP_RIGHT", "SHARP_LEFT", "BEAR_RIGHT", "SLIGHT_LEFT", "ARRIVE")
ICONS = ("TurnLeft", "TurnRight", "RoundaboutRight", "RoundaboutLeft", "UTurn", "MergeLeft", "ExitRight", "ExitLeft", "ForkRight", "SharpLeft", "BearRight", "BearLeft", "Straight")


@query("j19_classify_maneuver", f"SELECT event_id, {list(ICONS)}[event_id % 13 + 1] AS icon FROM events")
def _(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(m) for m in MOVES]), (C("event_id") % 13 + 1).cast("int"))
    return view(spark, sf_dir, "events").select("event_id", P.classify_maneuver(name).alias("icon"))


@query("j20_route_summary", having("route_legs") + ", r AS (SELECT route_id, max(offset_m) AS m, max(idx) * 95 AS s FROM route_legs GROUP BY route_id) SELECT route_id, concat(CAST(ceil(s / 60.0) AS BIGINT), ' min  •  ', CASE WHEN m IS NULL THEN 'Distance unavailable' WHEN m < 1000 THEN concat(m, ' m') ELSE concat(CAST(floor(round(m / 1000.0, 1)) AS BIGINT), '.', CAST(round(round(m / 1000.0, 1) * 10) AS BIGINT) % 10, ' km') END) AS summary FROM r")
def _(spark, sf_dir):
    r = view(spark, sf_dir, "route_legs").groupBy("route_id").agg(F.max("offset_m").cast("double").alias("m"), (F.max("idx") * 95).alias("s"))
    return r.select("route_id", P.route_summary(C("s"), C("m")).alias("summary"))


RECENT = having("points") + ", v AS (SELECT device, round(lat / 20) * 20 AS lat, round(lon / 60) * 60 AS lon, max(ts) AS ts, arg_max(kind, ts) AS name FROM points GROUP BY ALL)\n"


@query("j21_recent_places", RECENT + "SELECT device AS user_id, lat, lon, name, ts, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY device ORDER BY ts DESC, lat, lon) AS INT) AS rank FROM v) WHERE rank <= 10")
def _(spark, sf_dir):
    e = view(spark, sf_dir, "points").select(C("device").alias("user_id"), (F.round(C("lat") / 20) * 20).alias("lat"), (F.round(C("lon") / 60) * 60).alias("lon"), "ts", C("kind").alias("name"))
    return P.recent_places(e)


@query("j22_suggest_places", having("places") + ", u AS (SELECT *, CASE WHEN place_id % 5 = 0 THEN 0 WHEN place_id % 5 = 1 THEN 1 ELSE 2 END AS source FROM places), k AS (SELECT * FROM u WHERE source = 2 OR contains(lower(name), '12') OR contains(lower(address), '12')) SELECT place_id, name, address, lat, lon, source FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY source, place_id) AS r FROM k) WHERE r = 1")
def _(spark, sf_dir):
    p = view(spark, sf_dir, "places")
    return P.suggest_places(p.filter("place_id % 5 = 0"), p.filter("place_id % 5 = 1"), p.filter("place_id % 5 > 1"), " 12 ")


CARD_TITLES = "['Unknown','Accident','Fog','Dangerous conditions','Rain','Ice','Congestion','Lane closed','Road closed','Road works','Wind','Flooding','Detour','Multiple incidents','Broken-down vehicle']"


@query("j23_incident_card", having("incidents") + f"SELECT incident_id, coalesce(CASE WHEN incident_id % 4 = 0 THEN description END, CASE WHEN category BETWEEN 0 AND 14 THEN {CARD_TITLES}[category + 1] END, 'Traffic incident') AS title, concat(regexp_replace(CAST(CAST(round(delay_s / 60, 1) AS DECIMAL(18, 1)) AS VARCHAR), '\\.0$', ''), ' min delay') AS delay_text, incident_id % 2 = 0 AS has_times FROM incidents")
def _(spark, sf_dir):
    i = view(spark, sf_dir, "incidents").select("incident_id", F.when(C("incident_id") % 4 == 0, C("description")).alias("incident_type"), "category", "delay_s", F.when(C("incident_id") % 2 == 0, F.lit("x")).alias("start_time"), F.lit(None).cast("string").alias("end_time"))
    return T.incident_card(i)


D = "(1000 / 111320.0)"


@query("j24_places_extent", having("places") + f", e AS (SELECT place_id, lat, lon, {D} / greatest(0.01, cos(radians(lat))) AS e FROM places), c AS (SELECT place_id, greatest(-85, least(85, lat + {D})) AS lat, lon - e + 540 AS w FROM e UNION ALL SELECT place_id, greatest(-85, least(85, lat - {D})), lon + e + 540 FROM e) SELECT place_id, round(lat, 6) AS lat, round(w - 360 * floor(w / 360) - 180, 6) AS lon FROM c")
def _(spark, sf_dir):
    return view(spark, sf_dir, "places").select("place_id", F.explode(P.neighbourhood(C("lat"), C("lon"))).alias("k")).select("place_id", F.round("k.lat", 6).alias("lat"), F.round("k.lon", 6).alias("lon"))


@query("a01_read_places", having("places") + "SELECT place_id, name, lat, lon FROM places WHERE name <> '' AND address IS NOT NULL")
def _(spark, sf_dir):
    return P.valid_places(view(spark, sf_dir, "places")).select("place_id", "name", "lat", "lon")


@query("i05_hover_transitions", having("pointer_events") + "SELECT pointer_id, ts, exited, target AS entered FROM (SELECT *, lag(target) OVER (PARTITION BY pointer_id ORDER BY ts, event_id) AS exited FROM pointer_events) WHERE target IS DISTINCT FROM exited")
def _(spark, sf_dir):
    return T.hover_transitions(view(spark, sf_dir, "pointer_events"))


@query("k01_latest_positions", having("points") + "SELECT device, ts, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts DESC, point_id DESC) AS r FROM points) WHERE r = 1")
def _(spark, sf_dir):
    return E.latest_positions(view(spark, sf_dir, "points"))


@query("k03_icon_updates", having("elements", "points") + ", u AS (SELECT point_id % 2000 AS element_id, arg_max(lon, point_id) AS ulon, arg_max(lat, point_id) AS ulat FROM points GROUP BY 1) SELECT element_id, round(coalesce(ulon, lon), 6) AS lon, round(coalesce(ulat, lat), 6) AS lat FROM elements LEFT JOIN u USING (element_id)")
def _(spark, sf_dir):
    s = view(spark, sf_dir, "elements").select("element_id", "lon", "lat")
    u = view(spark, sf_dir, "points").select((C("point_id") % 2000).alias("element_id"), "lon", "lat", "point_id")
    return E.apply_updates(s, u, "element_id", "point_id").withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


@query("k04_drop_stale", having("points") + ", g AS (SELECT point_id, device, ts, (point_id * 37) % 1000 // 50 AS generation FROM points) SELECT point_id, device, generation FROM (SELECT *, max(generation) OVER (PARTITION BY device ORDER BY ts, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM g) WHERE generation = m")
def _(spark, sf_dir):
    g = view(spark, sf_dir, "points").withColumn("generation", F.floor((C("point_id") * 37) % 1000 / 50))
    return E.drop_stale(g, "device", ["ts", "point_id"]).select("point_id", "device", "generation")


@query("k05_wave_summary", having("tile_events") + "SELECT source_id, generation, scene_version, count(*) FILTER (state = 'completed') AS n_completed, count(*) FILTER (state = 'failed') AS n_failed, count(*) FILTER (state = 'cancelled') AS n_cancelled, round(sum(total_ms), 4) AS total_ms, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS span_ms FROM tile_events GROUP BY ALL")
def _(spark, sf_dir):
    return E.wave_summary(view(spark, sf_dir, "tile_events"))


PEAK = having("tile_events") + ", s AS (SELECT source_id, epoch_us(ts) AS t0, 1 AS d FROM tile_events UNION ALL SELECT source_id, epoch_us(ts) + CAST(round(total_ms * 1000) AS BIGINT), -1 FROM tile_events), t AS (SELECT source_id, t0, sum(d) AS d FROM s GROUP BY ALL), r AS (SELECT source_id, sum(d) OVER (PARTITION BY source_id ORDER BY t0) AS n FROM t)\n"


@query("k05_peak_concurrency", PEAK + "SELECT source_id, CAST(max(n) AS BIGINT) AS peak FROM r GROUP BY source_id")
def _(spark, sf_dir):
    return E.peak_concurrency(view(spark, sf_dir, "tile_events"), ["source_id"])


@query("k07_coverage_milestones", having("tile_events") + """, q AS (SELECT DISTINCT source_id, generation, scene_version, z, x, y
  FROM tile_events
  WHERE (x + y) % 2 = 0),
f AS (SELECT source_id, generation, scene_version, z, x, y, min(ts) AS seen
  FROM tile_events
  WHERE state = 'completed' GROUP BY ALL),
j AS (SELECT q.source_id, q.generation, q.scene_version, min(seen) AS first_tile, count(*) AS n, count(seen) AS m, max(seen) AS l
  FROM q
  LEFT JOIN f USING (source_id, generation, scene_version, z, x, y) GROUP BY ALL) SELECT source_id, generation, scene_version, first_tile, CASE
  WHEN n = m THEN l END AS full_coverage, CASE
  WHEN n = m THEN l + INTERVAL 250 MILLISECONDS END AS opaque_coverage
  FROM j""")
def _(spark, sf_dir):
    e = view(spark, sf_dir, "tile_events")
    return E.milestones(e.filter((C("x") + C("y")) % 2 == 0), e.filter("state = 'completed'"))


@query("k08_request_timing", having("tile_events") + "SELECT date_trunc('day', ts) AS start, source_id, count(*) AS n, round(avg(download_ms), 6) AS download_ms, round(avg(decode_ms), 6) AS decode_ms, round(max(total_ms), 6) AS worst_ms FROM tile_events GROUP BY ALL")
def _(spark, sf_dir):
    return E.request_timing(view(spark, sf_dir, "tile_events"))


@query("k09_failure_counts", having("tile_events") + "SELECT z, status_code, count(*) AS n, CASE WHEN status_code IN (401, 403) THEN 'authentication' WHEN status_code = 429 THEN 'throttled' WHEN status_code IN (400, 404) THEN 'request' ELSE 'other' END AS user_class FROM tile_events WHERE state = 'failed' GROUP BY z, status_code")
def _(spark, sf_dir):
    return E.failure_counts(view(spark, sf_dir, "tile_events"))


@query("k10_changed_only", having("points") + ", s AS (SELECT device, epoch_us(ts) // 3600000000 AS version, list_sort(list(DISTINCT kind)) AS names FROM points GROUP BY ALL) SELECT device, version, names FROM (SELECT *, coalesce(lag(names) OVER (PARTITION BY device ORDER BY version), []) AS b FROM s) WHERE names <> b")
def _(spark, sf_dir):
    s = view(spark, sf_dir, "points").groupBy("device", T.refresh_version(C("ts"), 3600).alias("version")).agg(F.sort_array(F.collect_set("kind")).alias("names"))
    return E.changed_only(s, "device")


# Six hours and 3,000 km since the last position that was passed on.
@query("k02_movement_filter", having("points").replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (
  SELECT device, point_id, lon, lat, epoch_us(ts) AS us, row_number() OVER (PARTITION BY device ORDER BY ts, point_id) AS n FROM points
), r AS (
  SELECT device, point_id, lon, lat, n, true AS moved, us AS last_us, lat AS last_lat, lon AS last_lon FROM o WHERE n = 1
  UNION ALL SELECT device, point_id, lon, lat, n, moved, CASE WHEN moved THEN us ELSE last_us END, CASE WHEN moved THEN lat ELSE last_lat END, CASE WHEN moved THEN lon ELSE last_lon END FROM (
    SELECT o.*, last_us, last_lat, last_lon, us - last_us >= 21600000000 AND 2 * {M.EARTH_RADIUS_M} * asin(sqrt(pow(sin(radians(o.lat - last_lat) / 2), 2) + cos(radians(last_lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - last_lon) / 2), 2))) >= 3000000 AS moved
    FROM r JOIN o ON o.device = r.device AND o.n = r.n + 1)
)
SELECT device, point_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM r WHERE moved""")
def _(spark, sf_dir):
    moved = E.movement_filter(view(spark, sf_dir, "points"), 3_000_000.0, 21_600.0)
    return moved.select("device", "point_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("k11_cadence_windows", having("points") + "SELECT epoch_us(ts) // 300000000 AS version, count(*) AS n, count(DISTINCT device) AS n_sources FROM points GROUP BY 1")
def _(spark, sf_dir):
    return E.cadence_windows(view(spark, sf_dir, "points"), 300)
