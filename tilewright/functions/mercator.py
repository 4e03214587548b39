"""Web-Mercator and tile-grid functions: columns in, columns out.

Longitudes and latitudes are degrees; world coordinates run from 0 to 1 over the square world (y grows southwards).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The map's limits and the sizes that its results depend on.
MAX_LATITUDE = 85.05112878
MAX_ZOOM = 22
MAX_PITCH = 60.0
TILE_SIZE = 256.0
FIELD_OF_VIEW = 40.0
EXTENT_3857 = 20037508.342789244
EQUATOR_M = 40075016.68557849
EARTH_RADIUS_M = 6371000.0
INFINITY = float("inf")


def finite(*columns: Column) -> Column:
    """Neither null, NaN nor infinite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INFINITY)
    return ok


def clamp(x: Column, low: object, high: object) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def normalize_longitude(lon: Column) -> Column:
    """To [-180, 180); +180 stays for what lands there from the east; 0 if not finite."""
    wrapped = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return F.when(finite(lon), F.when((wrapped == -180.0) & (lon > 0), F.lit(180.0)).otherwise(wrapped)).otherwise(F.lit(0.0))


def lon_to_world_x(lon: Column) -> Column:
    return (normalize_longitude(lon) + 180.0) / 360.0


def lat_to_world_y(lat: Column) -> Column:
    phi = clamp(lat, -MAX_LATITUDE, MAX_LATITUDE) * math.pi / 180.0
    return (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0


def world_x_to_lon(x: Column) -> Column:
    return F.pmod(x, F.lit(1.0)) * 360.0 - 180.0


def world_y_to_lat(y: Column) -> Column:
    return clamp(F.atan(F.sinh(math.pi * (1.0 - 2.0 * clamp(y, 0.0, 1.0)))) * 180.0 / math.pi, -MAX_LATITUDE, MAX_LATITUDE)


def cells_at(z: Column) -> Column:
    """2**z, for z from 0 to 62."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))


def cell_x(lon: Column, n: Column) -> Column:
    return clamp(F.floor(lon_to_world_x(lon) * n), F.lit(0).cast("long"), n.cast("long") - 1)


def cell_y(lat: Column, n: Column) -> Column:
    return clamp(F.floor(lat_to_world_y(lat) * n), F.lit(0).cast("long"), n.cast("long") - 1)


def tile_x(lon: Column, z: Column) -> Column:
    return cell_x(lon, cells_at(z)).cast("int")


def tile_y(lat: Column, z: Column) -> Column:
    return cell_y(lat, cells_at(z)).cast("int")


def tile_west(z: Column, x: Column) -> Column:
    return x / cells_at(z) * 360.0 - 180.0


def tile_east(z: Column, x: Column) -> Column:
    return (x + 1) / cells_at(z) * 360.0 - 180.0


def tile_north(z: Column, y: Column) -> Column:
    return world_y_to_lat(y / cells_at(z))


def tile_south(z: Column, y: Column) -> Column:
    return world_y_to_lat((y + 1) / cells_at(z))


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    return F.struct(tile_west(z, x).alias("west"), tile_south(z, y).alias("south"), tile_east(z, x).alias("east"), tile_north(z, y).alias("north"))


def tile_bbox_3857(z: Column, x: Column, y: Column) -> Column:
    """Metres: west, south, east, north."""
    size = F.lit(2 * EXTENT_3857) / cells_at(z)
    return F.struct(
        (x * size - EXTENT_3857).alias("west"), (F.lit(EXTENT_3857) - (y + 1) * size).alias("south"), ((x + 1) * size - EXTENT_3857).alias("east"), (F.lit(EXTENT_3857) - y * size).alias("north")
    )


def tile_intersects(z: Column, x: Column, y: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Tiles that only touch the bounds do not count."""
    return (tile_west(z, x) < east) & (tile_east(z, x) > west) & (tile_south(z, y) < north) & (tile_north(z, y) > south)


def quadkey(z: Column, x: Column, y: Column) -> Column:
    """Base-4 digits from the coarsest level; "" at zoom 0."""
    bit = lambda v, i: F.call_function("shiftright", v.cast("int"), i - 1).bitwiseAND(F.lit(1))
    digits = F.transform(F.sequence(z.cast("int"), F.lit(1), F.lit(-1)), lambda i: (bit(x, i) + 2 * bit(y, i)).cast("string"))
    return F.when(z > 0, F.array_join(digits, "")).otherwise(F.lit(""))


def tms_y(z: Column, y: Column) -> Column:
    return (cells_at(z) - 1 - y).cast("int")


def subdomain(z: Column, x: Column, y: Column, names: Column) -> Column:
    """A pick that depends on the tile alone: unsigned 32-bit products of its numbers and three primes. Null without names."""
    low = F.lit(4294967295)
    part = lambda v, prime: (v.cast("long") * F.lit(prime)).bitwiseAND(low)
    mixed = part(x, 73856093).bitwiseXOR(part(y, 19349663)).bitwiseXOR(part(z, 83492791))
    return F.when(F.size(names) > 0, F.element_at(names, (F.pmod(mixed, F.greatest(F.size(names), F.lit(1))) + 1).cast("int")))


def expand_tile_url(template: Column, z: Column, x: Column, y: Column, *, row: Column | None = None, names: Column | None = None) -> Column:
    """Placeholders in any case: {z} {x} {y} [level] [column] [row] {quadkey} {bbox-epsg-3857} {subdomain}."""
    y_out = y if row is None else row
    box = tile_bbox_3857(z, x, y)
    parts = [(r"\{z\}|\[level\]", z), (r"\{x\}|\[column\]", x), (r"\{y\}|\[row\]", y_out), (r"\{quadkey\}", quadkey(z, x, y)), (r"\{bbox-epsg-3857\}", F.concat_ws(",", *[box[k].cast("string") for k in ("west", "south", "east", "north")]))]
    if names is not None:
        parts.append((r"\{subdomain\}", F.coalesce(subdomain(z, x, y, names), F.lit(""))))
    out = template
    for pattern, value in parts:
        out = F.regexp_replace(out, F.lit(f"(?i){pattern}"), value.cast("string"))
    return out


def is_valid_tile_template(url: Column) -> Column:
    """Empty, or an absolute http(s) address in which no brace is left beside the known placeholders."""
    bare = F.regexp_replace(url, r"(?i)\{(z|x|y|quadkey|bbox-epsg-3857|subdomain)\}|\[(level|column|row)\]", "0")
    return F.coalesce((F.trim(url) == "") | (bare.rlike(r"(?i)^https?://[^/?#\s]+") & ~bare.rlike(r"[{}]")), F.lit(True))


def source_zoom(camera_zoom: Column, tile_size: Column) -> Column:
    shift = F.log2(F.lit(TILE_SIZE) / tile_size)
    return F.greatest(F.lit(0), F.least(F.floor(camera_zoom + shift), F.floor(camera_zoom + 3.0))).cast("int")


def clamp_source_zoom(requested: Column, low: Column, high: Column) -> Column:
    return F.when(requested >= low, F.least(requested, high))


def normalize_heading(heading: Column) -> Column:
    return F.when(finite(heading), F.pmod(heading, F.lit(360.0))).otherwise(F.lit(0.0))


def normalize_pitch(pitch: Column) -> Column:
    return F.when(finite(pitch), clamp(pitch, 0.0, MAX_PITCH)).otherwise(F.lit(0.0))


def normalize_zoom(zoom: Column) -> Column:
    return F.when(finite(zoom), clamp(zoom, 0.0, float(MAX_ZOOM))).otherwise(F.lit(0.0))


def shortest_heading_delta(before: Column, after: Column) -> Column:
    return F.pmod(normalize_heading(after) - normalize_heading(before) + 540.0, F.lit(360.0)) - 180.0


def world_size(zoom: Column) -> Column:
    return TILE_SIZE * F.pow(F.lit(2.0), normalize_zoom(zoom))


def perspective_distance(viewport_height: Column) -> Column:
    return F.greatest(F.lit(1.0), viewport_height * (0.5 / math.tan(math.radians(FIELD_OF_VIEW / 2))))


def rotated(x: Column, y: Column, heading: Column) -> tuple[Column, Column]:
    r = normalize_heading(heading) * math.pi / 180.0
    return x * F.cos(r) + y * F.sin(r), y * F.cos(r) - x * F.sin(r)


def to_viewport(x: Column, y: Column, heading: Column, pitch: Column, height: Column) -> tuple[Column, Column]:
    """Map-plane offsets from the centre, turned and seen in perspective."""
    x, y = rotated(x, y, heading)
    r = normalize_pitch(pitch) * math.pi / 180.0
    far = perspective_distance(height)
    scale = far / F.greatest(F.lit(1.0), far - y * F.sin(r))
    return F.when(r == 0.0, x).otherwise(x * scale), F.when(r == 0.0, y).otherwise(y * F.cos(r) * scale)


def from_viewport(x: Column, y: Column, heading: Column, pitch: Column, height: Column) -> tuple[Column, Column]:
    r = normalize_pitch(pitch) * math.pi / 180.0
    far = perspective_distance(height)
    down = far * F.cos(r) + y * F.sin(r)
    flat = F.when(down == 0.0, F.lit(0.0)).otherwise(y * far / F.nullif(down, F.lit(0.0)))
    return rotated(F.when(r == 0.0, x).otherwise(x * (far - flat * F.sin(r)) / far), F.when(r == 0.0, y).otherwise(flat), -heading)


def project_to_viewport(lon: Column, lat: Column, cam_lon: Column, cam_lat: Column, zoom: Column, width: Column, height: Column, heading: Column, pitch: Column) -> Column:
    """struct<x,y> in pixels, or null for input or results that are not finite, or an empty viewport."""
    size = world_size(zoom)
    dx = lon_to_world_x(lon) - lon_to_world_x(cam_lon)
    x = (dx - F.rint(dx)) * size
    y = lat_to_world_y(lat) * size - clamp(lat_to_world_y(cam_lat) * size, F.lit(0.0), size)
    x, y = to_viewport(x, y, heading, pitch, height)
    x, y = x + width / 2, y + height / 2
    return F.when(finite(lon, lat, cam_lon, cam_lat, width, height) & (width > 0) & (height > 0) & finite(x, y), F.struct(x.alias("x"), y.alias("y")))


def viewport_to_location(px: Column, py: Column, cam_lon: Column, cam_lat: Column, zoom: Column, width: Column, height: Column, heading: Column, pitch: Column) -> Column:
    """struct<lon,lat>, or null outside the viewport."""
    x, y = from_viewport(px - width / 2, py - height / 2, heading, pitch, height)
    size = world_size(zoom)
    inside = finite(px, py, width, height) & (width > 0) & (height > 0) & px.between(F.lit(0.0), width) & py.between(F.lit(0.0), height)
    return F.when(inside, F.struct(world_x_to_lon(lon_to_world_x(cam_lon) + x / size).alias("lon"), world_y_to_lat(lat_to_world_y(cam_lat) + y / size).alias("lat")))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = math.pi / 180.0
    a = F.pow(F.sin((lat2 - lat1) * rad / 2), F.lit(2.0)) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.pow(F.sin((lon2 - lon1) * rad / 2), F.lit(2.0))
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(clamp(a, 0.0, 1.0)))


def meters_to_tile_units(z: Column, y: Column) -> Column:
    """Tile widths of a metre, at the latitude of the tile's row y (a fraction stands inside the tile)."""
    return cells_at(z) / (EQUATOR_M * F.cos(world_y_to_lat(y / cells_at(z)) * math.pi / 180.0))


def rectangle_visible(left: Column, top: Column, width: Column, height: Column, view_width: Column, view_height: Column) -> Column:
    ok = finite(left, top, width, height, view_width, view_height) & (width > 0) & (height > 0) & (view_width > 0) & (view_height > 0)
    return F.coalesce(ok & (left < view_width) & (left + width > 0) & (top < view_height) & (top + height > 0), F.lit(False))
