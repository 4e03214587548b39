"""Places, favourites, searches and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import mercator as M

#: The world's box as it is shown first, and units of distances.
BOX, WORLD, MOST_REGIONS = ("west", "south", "east", "north"), (-180, -70, 180, 80), 1000
METERS_PER_MILE, FEET_PER_METER, FEET_LIMIT = 1609.344, 3.280839895, 528


def valid_places(df: DataFrame) -> DataFrame:
    """Rows with a name that is not empty, an address, and finite coordinates in range."""
    ok = (F.col("name") != "") & F.col("address").isNotNull() & M.finite(F.col("lat"), F.col("lon")) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return df.filter(F.coalesce(ok, F.lit(False)))


def first_at_place(places: DataFrame, order: list[str]) -> DataFrame:
    """The first row, by order, at each exact position. Reduced before the shuffle."""
    others = [c for c in places.columns if c not in ("lat", "lon", *order)]
    rows = places.groupBy("lat", "lon").agg(F.min(F.struct(*order, *others)).alias("_f"))
    return rows.select(*[F.col(c) if c in ("lat", "lon") else F.col(f"_f.{c}").alias(c) for c in places.columns])


def is_category(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, is_category): whether a term equals the query, or starts with it and a space; case and accents do not count.

    Every term is indexed by each of its beginnings that ends before a space, so queries and terms meet by equal keys.
    """
    folded = lambda c: F.lower(F.translate(F.col(c), "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"))
    words = F.split(F.col("_t"), " ")
    starts = terms.select(folded("term").alias("_t")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))).alias("_key")).distinct()
    return queries.select("query", folded("query").alias("_key")).join(starts.withColumn("_hit", F.lit(True)), "_key", "left").select("query", F.coalesce("_hit", F.lit(False)).alias("is_category"))


def filter_places(results: DataFrame, geographic: Column, exact: Column, lat: Column, lon: Column, radius_m: float) -> DataFrame:
    """Where the search is geographic only exact matches stay; else all but points of interest beyond the radius."""
    near = (F.col("entity_type") != "POI") | (M.haversine_m(F.col("lat"), F.col("lon"), lat, lon) <= radius_m)
    return results.filter(F.when(geographic, exact).otherwise(near)).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "address"))


def search_area(corners: DataFrame) -> DataFrame:
    """(scene_id, radius_m): 1.25 times the way from the centre to the farthest corner, rounded up, from 1000 to 50000."""
    far = F.max(M.haversine_m(F.col("lat"), F.col("lon"), F.col("corner_lat"), F.col("corner_lon")) * 1.25)
    return corners.groupBy("scene_id").agg(F.least(F.greatest(F.ceil(far), F.lit(1000)), F.lit(50000)).cast("int").alias("radius_m"))


def apply_favorite_events(events: DataFrame) -> DataFrame:
    """(user_id, place_id, name): favourites after toggles and renames in order of seq.

    A toggle adds a place or takes it away; it is there after an odd number of them. A rename with a name that is not blank holds
    if the place was there and has not been added anew since.
    """
    by = Window.partitionBy("user_id", "place_id").orderBy("seq")
    toggles = F.sum(F.when(F.col("action") == "toggle", 1).otherwise(0)).over(by)
    marked = events.withColumn("_t", toggles)
    rename = (F.col("action") == "rename") & (F.trim("new_name") != "") & (F.col("_t") % 2 == 1)
    return (
        marked.groupBy("user_id", "place_id").agg(F.max("_t").alias("_n"), F.max_by(F.trim("new_name"), F.when(rename, F.struct("_t", "seq"))).alias("_name"), F.max(F.when(rename, F.col("_t"))).alias("_at"))
        .filter(F.col("_n") % 2 == 1).select("user_id", "place_id", F.when(F.col("_at") == F.col("_n"), F.col("_name")).alias("name"))
    )


def recent_places(events: DataFrame, k: int = 10) -> DataFrame:
    """(user_id, lat, lon, name, ts, rank): a user's k most recent positions, each once with its latest name."""
    last = events.groupBy("user_id", "lat", "lon").agg(F.max(F.struct("ts", "name")).alias("_l")).select("user_id", "lat", "lon", "_l.ts", "_l.name")
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "lat", "lon")
    return last.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def suggest_places(favorites: DataFrame, recent: DataFrame, results: DataFrame, query: str) -> DataFrame:
    """Favourites, then recent places, then results, of which the first two must hold the query in name or address; each position once, its first."""
    q = query.strip().lower()
    holds = F.lit(True) if not q else F.lower("name").contains(q) | F.lower("address").contains(q)
    parts = [favorites.filter(holds), recent.filter(holds), results]
    rows = [p.select("place_id", "name", "address", "lat", "lon").withColumn("source", F.lit(i)) for i, p in enumerate(parts)]
    return first_at_place(rows[0].unionByName(rows[1]).unionByName(rows[2]), ["source", "place_id"])


def region_bounds(rows: DataFrame, regions: DataFrame, code: str = "region") -> DataFrame:
    """rows with west, south, east and north of the region that their code names (trimmed, in capitals); the world's where it names none.

    regions: code, west, south, east, north: a list of countries, of some 250 rows; it is sent to all only if it is as short as that.
    """
    named = regions.select(F.col("code").alias("_code"), *BOX)
    small = F.broadcast(named) if named.limit(MOST_REGIONS + 1).count() <= MOST_REGIONS else named
    met = rows.drop(*BOX).withColumn("_key", F.upper(F.trim(code))).join(small, F.col("_key") == F.col("_code"), "left")
    return met.select(*[c for c in rows.columns if c not in BOX], *[F.coalesce(b, F.lit(float(w))).alias(b) for b, w in zip(BOX, WORLD, strict=True)])


def neighbourhood(lat: Column, lon: Column) -> Column:
    """Two corners of the square kilometre or so about a place: array<struct<lat,lon>>."""
    d = 1000 / 111320.0
    e = d / F.greatest(F.lit(0.01), F.cos(F.radians(lat)))
    wrap = lambda x: F.pmod(x + 540.0, F.lit(360.0)) - 180.0
    return F.array(F.struct(M.clamp(lat + d, -85.0, 85.0).alias("lat"), wrap(lon - e).alias("lon")), F.struct(M.clamp(lat - d, -85.0, 85.0).alias("lat"), wrap(lon + e).alias("lon")))


def route_points(legs: DataFrame) -> DataFrame:
    """(route_id, point_index, lat, lon) of the legs' points in order; routes with fewer than two points, or one that is not finite or in range, have none."""
    good = M.finite(F.col("lat"), F.col("lon")) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    sound = legs.groupBy("route_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_ok"), F.count("*").alias("_n")).filter("_ok AND _n >= 2").select("route_id")
    order = Window.partitionBy("route_id").orderBy("leg", "idx")
    return legs.join(sound, "route_id").select("route_id", (F.row_number().over(order) - 1).alias("point_index"), "lat", "lon")


def route_steps(instructions: DataFrame, points: DataFrame) -> DataFrame:
    """(route_id, seq, lat, lon, metres, error): steps at their points; metres from the last offset that is known (0 before the first), never negative."""
    before = F.coalesce(F.last("offset_m", ignorenulls=True).over(Window.partitionBy("route_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = instructions.withColumn("metres", F.greatest(F.lit(0), F.col("offset_m") - before))
    steps = steps.withColumn("metres", F.when(F.col("offset_m").isNotNull(), F.col("metres")))
    return steps.join(points, ["route_id", "point_index"], "left").select("route_id", "seq", "lat", "lon", "metres", F.col("lat").isNull().alias("error"))


def grouped_number(x: Column, places: int) -> Column:
    return F.format_number(F.round(x, places), places)


def format_distance(m: Column, metric: bool = True) -> Column:
    if metric:
        return F.when(m.isNull(), "").when(m < 1000, F.concat(grouped_number(m, 0), F.lit(" m"))).otherwise(F.concat(grouped_number(m / 1000, 1), F.lit(" km")))
    feet = m * FEET_PER_METER
    return F.when(m.isNull(), "").when(feet < FEET_LIMIT, F.concat(grouped_number(feet, 0), F.lit(" ft"))).otherwise(F.concat(grouped_number(m / METERS_PER_MILE, 1), F.lit(" mi")))


def classify_maneuver(text: Column) -> Column:
    """Icon of a manoeuvre's name, by the first rule that it meets."""
    t = F.upper(F.coalesce(text, F.lit("")))
    left, right = t.contains("LEFT"), t.contains("RIGHT")
    sided = lambda word, side, one, other: (t.contains(word), F.when(side, one).otherwise(other))
    rules = [
        sided("ROUNDABOUT", right, "RoundaboutRight", "RoundaboutLeft"), sided("UTURN", right, "UTurnRight", "UTurn"), sided("MERGE", right, "MergeRight", "MergeLeft"), sided("EXIT", left, "ExitLeft", "ExitRight"),
        sided("KEEP", left, "ForkLeft", "ForkRight"), sided("SHARP", left, "SharpLeft", "SharpRight"), sided("BEAR", left, "BearLeft", "BearRight"), sided("SLIGHT", left, "BearLeft", "BearRight"), (left, F.lit("TurnLeft")), (right, F.lit("TurnRight")),
    ]
    out = F.when(*rules[0])
    for r in rules[1:]:
        out = out.when(*r)
    return out.otherwise("Straight")


def route_summary(seconds: Column, metres: Column, metric: bool = True) -> Column:
    time = F.when(seconds.isNotNull(), F.concat(F.format_number(F.ceil(seconds / 60), 0), F.lit(" min"))).otherwise("Time unavailable")
    return F.concat(time, F.lit("  \u2022  "), F.when(metres.isNotNull(), format_distance(metres, metric)).otherwise("Distance unavailable"))
