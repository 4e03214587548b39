"""Places, tile services, styles and telemetry as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.staging import in_order

#: Bits of the keywords that events carry.
KEYWORDS = {"lifecycle": 1, "device": 2, "camera": 4, "tiles": 8, "cache": 16, "icons": 32, "errors": 64, "custom_tiles": 128, "vector_tiles": 256, "accessibility": 512, "frames": 1024}
#: Levels of events, the gravest first.
LEVELS = ("critical", "error", "warning", "informational", "verbose")
NO_ATTRIBUTION = "Contributors"


def indexed_places(places: DataFrame, order: list[str]) -> DataFrame:
    """(item, n_items, name, address, lat, lon): places numbered from 0 without gaps, in order, with their count. Numbers are taken by ranges of the order."""
    ranked = in_order(places, order, "item")
    return ranked.select("item", F.lit(ranked.count()).alias("n_items"), "name", "address", "lat", "lon")


def write_places(places: DataFrame, path: str, order: list[str]) -> None:
    """Replaces what is at path with all places, numbered."""
    indexed_places(places, order).write.mode("overwrite").parquet(path)


def tile_service(text: str = "json") -> list:
    """Columns of a tile service's description in JSON: tile_url (the first one), style_url, tile_size, min_zoom, max_zoom, attribution, and error: tiles must be square, of 1 to 4096
    pixels, and there must be a level, a tile address and styles."""
    d = F.from_json(text, "tiles array<string>, defaultStyles string, tileInfo struct<rows:int,cols:int,lods:array<struct<level:int>>>, copyrightText string")
    rows, cols, levels = d["tileInfo"]["rows"], d["tileInfo"]["cols"], d["tileInfo"]["lods"]["level"]
    error = (
        F.when(F.get(d["tiles"], F.lit(0)).isNull() | d["defaultStyles"].isNull() | rows.isNull() | cols.isNull() | levels.isNull(), "something is missing")
        .when((rows != cols) | ~rows.between(1, 4096), "tiles are not square").when(F.size(levels) == 0, "there is no level").when(F.exists(levels, lambda v: v.isNull()), "a level has no number")
    )
    good = lambda v: F.when(error.isNull(), v)
    text_ = F.when(F.trim(d["copyrightText"]) != "", d["copyrightText"])
    return [good(F.get(d["tiles"], F.lit(0))).alias("tile_url"), good(d["defaultStyles"]).alias("style_url"), good(rows).alias("tile_size"), good(F.array_min(levels)).alias("min_zoom"), good(F.array_max(levels)).alias("max_zoom"), good(F.coalesce(text_, F.lit(NO_ATTRIBUTION))).alias("attribution"), error.alias("error")]


def read_tile_service_metadata(docs: DataFrame, text: str = "json") -> DataFrame:
    """docs with the columns of their description."""
    return docs.select(*[c for c in docs.columns if c != text], *tile_service(text))


def at_level(events: DataFrame, level: str, keywords: int) -> DataFrame:
    """Events (level: a name of LEVELS, keywords: bits) as grave as a level, or more so, that carry one of some keywords; 0 stands for all of them."""
    grave = F.array_position(F.array(*[F.lit(v) for v in LEVELS]), F.lower("level"))
    wanted = F.lit(True) if keywords == 0 else F.col("keywords").bitwiseAND(F.lit(keywords)) != 0
    return events.filter(grave.between(1, LEVELS.index(level) + 1) & wanted)


def read_telemetry(spark: SparkSession, path: str, schema: str, level: str, keywords: int, *, stream: bool = False) -> DataFrame:
    """Events of JSON lines, as a table or a stream: their levels and keywords are filtered as they are read."""
    reader = spark.readStream if stream else spark.read
    return at_level(reader.schema(schema).json(path), level, keywords)


LAYER = "id string, type string, source string, `source-layer` string, minzoom double, maxzoom double"


def read_style(docs: DataFrame, text: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., layer_order, layer_id, type, source, source_layer, min_zoom, max_zoom, visible, filter, layout, paint): the layers of styles in JSON, in order. Rules stay JSON
    texts, for the rule compiler; zooms are 0 and 24 where none is given; a visibility that is a rule stays in the layout, and counts as visible here."""
    layers = F.from_json(F.get_json_object(F.col(text), "$.layers"), "array<string>")
    rows = docs.select(*keep, F.posexplode(layers).alias("layer_order", "_layer"))
    at = lambda p: F.get_json_object("_layer", p)
    d = F.from_json("_layer", LAYER)
    visible = F.coalesce(at("$.layout.visibility") != "none", F.lit(True))
    return rows.select(*keep, "layer_order", d["id"].alias("layer_id"), d["type"].alias("type"), d["source"].alias("source"), d["source-layer"].alias("source_layer"), F.coalesce(d["minzoom"], F.lit(0.0)).alias("min_zoom"), F.coalesce(d["maxzoom"], F.lit(24.0)).alias("max_zoom"), visible.alias("visible"), at("$.filter").alias("filter"), at("$.layout").alias("layout"), at("$.paint").alias("paint"))
