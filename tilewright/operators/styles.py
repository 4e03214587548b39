"""Style layers applied to feature tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import mercator as M
from tilewright.functions.rules import RuleError, Scope, choose, compile_expression, compile_filter, from_legacy, is_legacy, shape_of
from tilewright.operators.staging import LEAST_HOT, spread_join, written

#: Kinds of geometry that a layer's type draws.
GEOMETRIES = {"line": ("LineString", "MultiLineString", "Polygon", "MultiPolygon"), "fill": ("Polygon", "MultiPolygon"), "symbol": ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"), "circle": ("Point", "MultiPoint")}
MOST_LAYERS = 4096


def scope_of(features: DataFrame, properties: list[str], zoom: Column) -> Scope:
    kinds = {"string": "string", "boolean": "boolean"}
    return Scope({p: (kinds.get(features.schema[p].dataType.simpleString(), "number"), F.col(p) if features.schema[p].dataType.simpleString() in kinds else F.col(p).cast("double")) for p in properties}, zoom, F.col("geometry_type"))


def layers_of(style: DataFrame) -> list[dict[str, Any]]:
    """The layers of one style, as the rule compiler takes them, of a table from `read_style`. A style is a document: it has a limit of layers."""
    rows = style.orderBy("layer_order").limit(MOST_LAYERS + 1).collect()
    if len(rows) > MOST_LAYERS:
        raise ValueError("a style has too many layers")
    rule = lambda v: None if v is None else json.loads(v)
    return [
        {"id": r.layer_id, "type": r.type, "source-layer": r.source_layer, "minzoom": r.min_zoom, "maxzoom": r.max_zoom, "visibility": "visible" if r.visible else "none", "filter": rule(r.filter), "layout": rule(r.layout) or {}, "paint": rule(r.paint) or {}}
        for r in rows
    ]


def resolve_layers(features: DataFrame, layers: list[dict[str, Any]], zoom: float | Column, properties: list[str], *, part: str = "paint", keep: tuple[str, ...] = ()) -> DataFrame:
    """(feature_id, keep..., layer_order, layer_id, paint..., failed): every feature with each layer that draws it; rows whose filter failed have no paint.

    A layer draws features of its source layer and of a geometry that its type has, if it is visible, min <= zoom < max and its filter matches. zoom may differ
    from row to row. Features are read once, whatever the number of layers: a row makes an array of what draws it. part: which of a layer's rules are resolved.
    """
    at = zoom if isinstance(zoom, Column) else F.lit(float(zoom))
    scope = scope_of(features, properties, at)
    names = sorted({k for layer in layers for k in layer.get(part, {})})
    drawn = []
    for order, layer in enumerate(layers):
        if layer.get("visibility") == "none" or layer.get("type") not in GEOMETRIES:
            continue
        match, failed = compile_filter(layer.get("filter"), scope)
        here = (F.col("source_layer") == layer["source-layer"]) & F.col("geometry_type").isin(*GEOMETRIES[layer["type"]]) & (at >= float(layer.get("minzoom", 0))) & (at < float(layer.get("maxzoom", 24)))
        values = []
        for n in names:
            v = compile_expression(layer.get(part, {}).get(n), scope)
            values.append(F.when(~failed & ~v.failed, v.value.cast("string")).alias(n))
        drawn.append(F.when(here & (match | failed), F.struct(F.lit(order).alias("layer_order"), F.lit(layer["id"]).alias("layer_id"), *values, failed.alias("failed"))))
    if not drawn:
        return features.limit(0).select("feature_id", *keep, F.lit(0).alias("layer_order"), F.lit("").alias("layer_id"), *[F.lit("").alias(n) for n in names], F.lit(False).alias("failed"))
    rows = features.select("feature_id", *keep, F.explode(F.filter(F.array(*drawn), lambda d: d.isNotNull())).alias("_d"))
    return rows.select("feature_id", *keep, "_d.*")


#: Shapes of rules that are compiled into one plan.
SHAPES = 64


def shaped_rules(part: str) -> Callable[[Column, Column], Column]:
    """A column of (shape, numbers, texts) of a layer's filter and part (JSON): equal shapes differ in their constants only. A rule that is not valid has no shape."""

    @F.pandas_udf("shape string, numbers array<double>, texts array<string>")
    def of(filters: pd.Series, parts: pd.Series) -> pd.DataFrame:
        out = []
        for f, p in zip(filters, parts, strict=True):
            numbers: list[float] = []
            texts: list[str] = []
            try:
                rule = None if f is None else json.loads(f)
                rule = None if rule is None else shape_of(from_legacy(rule) if is_legacy(rule) else rule, numbers, texts)
                values = {k: shape_of(v, numbers, texts) for k, v in sorted((json.loads(p) if p else {}).items())}
                out.append((json.dumps([rule, values]), numbers, texts))
            except (ValueError, TypeError, IndexError, KeyError, AttributeError):
                out.append((None, [], []))
        return pd.DataFrame(out, columns=["shape", "numbers", "texts"])

    return of


def compiled_shape(shape: str, scope: Scope) -> tuple[Column, Column, Column]:
    """(match, failed, paint: map of what did not fail) of a shape."""
    none = F.create_map().cast("map<string,string>")
    try:
        rule, values = json.loads(shape)
        match, failed = compile_filter(rule, scope)
        compiled = {k: compile_expression(v, scope) for k, v in values.items()}
    except (RuleError, TypeError, IndexError):
        return F.lit(False), F.lit(True), none
    if not compiled:
        return match, failed, none
    every = F.create_map(*[x for k, v in compiled.items() for x in (F.lit(k), F.when(~failed & ~v.failed, v.value.cast("string")))])
    return match, failed, F.map_filter(every, lambda k, v: v.isNotNull())


def resolve_styles(features: DataFrame, layers: DataFrame, zoom: Column, properties: list[str], by: list[str], *, part: str = "paint", keep: tuple[str, ...] = ("style_id",), least: int = LEAST_HOT) -> DataFrame:
    """(feature_id, by..., keep..., layer_order, layer_id, paint: map of texts, failed): features with the layers of any number of styles that draw them.

    layers: as from `read_style`, with columns `by` that say which features (of a source, or a map) a style is for, and `keep`. Features meet layers by these and the source layer. Rules are
    not compiled one by one: each is cut into a shape and its constants, and a shape is compiled once, however many styles have it, with the constants as columns. Layers whose rules are not valid
    fail for every feature that they would draw. zoom: a column of features or layers.
    """
    layers = written(layers.filter("visible").select(*by, *keep, "layer_order", "layer_id", "type", "source_layer", "min_zoom", "max_zoom", shaped_rules(part)(F.col("filter"), F.col(part)).alias("_rule")).filter(F.col("type").isin(*GEOMETRIES)), "layers")
    shapes = written(layers.select(F.col("_rule.shape").alias("_shape")).filter("_shape IS NOT NULL").distinct(), "shapes")
    drawn = F.lit(False)
    for kind, geometries in GEOMETRIES.items():
        drawn = drawn | ((F.col("type") == kind) & F.col("geometry_type").isin(*geometries))
    met = spread_join(features, layers, [*by, "source_layer"], least).withColumn("_zoom", zoom).filter(drawn & (F.col("_zoom") >= F.col("min_zoom")) & (F.col("_zoom") < F.col("max_zoom")))
    if shapes.count() > SHAPES:
        met = written(met, "drawn")
    scope = scope_of(features, properties, F.col("_zoom"))
    scope.parameters = {"number": F.col("_rule.numbers"), "string": F.col("_rule.texts")}
    columns = ["feature_id", *by, *keep, "layer_order", "layer_id"]
    out = met.filter("_rule.shape IS NULL").select(*columns, F.create_map().cast("map<string,string>").alias("paint"), F.lit(True).alias("failed"))
    block: list[str] = []

    def resolved(block: list[str]) -> DataFrame:
        parts = [compiled_shape(s, scope) for s in block]
        numbers = met.sparkSession.createDataFrame([(s, k) for k, s in enumerate(block)], "_shape string, _no int")
        rows = met.withColumn("_shape", F.col("_rule.shape")).join(F.broadcast(numbers), "_shape")
        rows = rows.withColumn("failed", choose(F.col("_no"), [p[1] for p in parts])).filter(F.col("failed") | choose(F.col("_no"), [p[0] for p in parts]))
        return rows.select(*columns, choose(F.col("_no"), [p[2] for p in parts]).alias("paint"), "failed")

    for r in shapes.orderBy("_shape").toLocalIterator():
        block.append(r["_shape"])
        if len(block) == SHAPES:
            out, block = out.unionByName(resolved(block)), []
    return out.unionByName(resolved(block)) if block else out


def failure_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("layer_id").agg(F.count_if(~F.col("failed")).alias("n_drawn"), F.count_if("failed").alias("n_failed"))


def representative(points: Column, lines: Column) -> Column:
    """Where a feature's label stands: the middle vertex of its first line that has any, else its first point."""
    line = F.get(F.filter(lines, lambda v: F.size(v) > 0), F.lit(0))
    return F.coalesce(F.get(line, F.floor(F.size(line) / 2).cast("int")), F.get(points, F.lit(0)))


def label_candidates(features: DataFrame, layers: list[dict[str, Any]], zoom: float | Column, properties: list[str], most: int = 256) -> DataFrame:
    """(source_id, z, x, y, place, layer_order, layer_id, feature_id, text, at): the first `most` labels of each source's tile by layer order and feature: texts, not blank, of the visible text layers whose filter
    holds. at: a column of features (struct<x,y>), where the label stands."""
    texts = [{**layer, "text": {"text": layer["layout"]["text-field"]}} if layer.get("layout", {}).get("text-field") is not None else {**layer, "visibility": "none"} for layer in layers]
    rows = resolve_layers(features, texts, zoom, properties, part="text", keep=("source_id", "z", "x", "y", "at")).filter(~F.col("failed") & (F.trim("text") != ""))
    order = Window.partitionBy("source_id", "z", "x", "y").orderBy("layer_order", "feature_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("source_id", "z", "x", "y", "place", "layer_order", "layer_id", "feature_id", "text", "at")


def project_features(features: DataFrame) -> DataFrame:
    """(feature_id, lon, lat) of tile-local positions (z, x, y, fx, fy)."""
    n = M.cells_at(F.col("z"))
    return features.select("feature_id", M.world_x_to_lon((F.col("x") + F.col("fx")) / n).alias("lon"), M.world_y_to_lat((F.col("y") + F.col("fy")) / n).alias("lat"))


#: Properties of layers that are drawn, by type and part; types that are known but not drawn; a property that is known but not drawn, and one that is passed over.
LAYOUT = {
    "background": "visibility", "fill": "visibility", "fill-extrusion": "visibility", "line": "visibility line-cap line-join line-miter-limit",
    "symbol": "visibility symbol-placement symbol-spacing symbol-sort-key symbol-avoid-edges icon-image icon-size icon-offset icon-anchor icon-padding icon-rotate icon-rotation-alignment icon-text-fit icon-text-fit-padding icon-allow-overlap icon-ignore-placement icon-optional text-field text-font text-size text-max-width text-line-height text-justify text-padding text-keep-upright text-max-angle text-offset text-anchor text-radial-offset text-letter-spacing text-transform text-rotation-alignment text-variable-anchor text-allow-overlap text-ignore-placement text-optional",
}
PAINT = {
    "background": "background-color background-opacity", "fill": "fill-color fill-opacity fill-outline-color fill-pattern fill-translate fill-translate-anchor fill-antialias",
    "fill-extrusion": "fill-extrusion-color fill-extrusion-opacity fill-extrusion-pattern fill-extrusion-translate fill-extrusion-translate-anchor fill-extrusion-height fill-extrusion-base fill-extrusion-vertical-gradient",
    "line": "line-color line-opacity line-width line-offset line-gap-width line-blur line-dasharray line-pattern line-gradient", "symbol": "icon-opacity icon-color text-color text-halo-color text-halo-width text-halo-blur text-opacity",
}
OTHER_TYPES, KNOWN_PROPERTY, PASSED_OVER = ("circle", "heatmap", "hillshade", "raster", "sky", "slot"), "background-pattern", "symbol-avoid-edges"


def style_compatibility(layers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., kind, construct, n): what layers (from `read_style`) hold that is not drawn: types, layout and paint properties ("other" for names that are not known), and layout properties
    that are passed over. The lists of what is drawn are columns, fixed above: nothing is joined."""

    def lists(of: dict[str, str]) -> Column:
        return F.create_map(*[v for k, names in of.items() for v in (F.lit(k), F.split(F.lit(names), " "))])

    kind = F.col("type")
    drawn = kind.isin(*LAYOUT)
    construct = lambda name: F.when(name == KNOWN_PROPERTY, name).otherwise("other")
    entry = lambda k, c: F.struct(k.alias("kind"), c.alias("construct"))

    def properties(part: str, of: dict[str, str]) -> Column:
        names = F.coalesce(F.json_object_keys(part), F.array().cast("array<string>"))
        passed = lambda v: (kind == "symbol") & (v == PASSED_OVER) & F.lit(part == "layout")
        odd = F.filter(names, lambda v: passed(v) | ~F.array_contains(F.try_element_at(lists(of), kind), v))
        return F.transform(odd, lambda v: entry(F.when(passed(v), "ignored layout").otherwise(F.lit(part)), F.when(passed(v), v).otherwise(construct(v))))

    types = F.array(entry(F.lit("type"), F.when(kind.isin(*OTHER_TYPES), kind).otherwise("other")))
    found = F.when(~drawn, types).when(drawn, F.concat(properties("layout", LAYOUT), properties("paint", PAINT)))
    return layers.filter(kind.isNotNull()).select(*by, F.explode(found).alias("_e")).groupBy(*by, "_e.kind", "_e.construct").agg(F.count("*").alias("n"))


def zoom_stops(rule: Any) -> set[float]:
    """The stops that a rule sets on the zoom."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if isinstance(rule, dict):
        own = {float(s[0]) for s in rule.get("stops", []) if isinstance(s, list) and s and number(s[0])} if "property" not in rule else set()
        return own.union(*(zoom_stops(v) for v in rule.values()))
    if not isinstance(rule, list):
        return set()
    inner = set().union(*map(zoom_stops, rule))
    if rule and rule[0] == "step" and len(rule) > 3 and rule[1] == ["zoom"]:
        inner |= {float(v) for v in rule[3::2] if number(v)}
    if rule and rule[0] == "interpolate" and len(rule) > 3 and rule[2] == ["zoom"]:
        inner |= {float(v) for v in rule[3::2] if number(v)}
    return inner


def zoom_breakpoints(layers: DataFrame, tile_zoom: int, by: str, most: int = 64) -> DataFrame:
    """(by, rank, zoom): the zooms at which a style's look changes while tiles of a zoom are shown: both ends of that zoom, and every stop on the zoom between, with a millionth before
    and after it; in order, the first `most`."""
    low = float(min(max(tile_zoom, 0), M.MAX_ZOOM))
    high = min(low + 0.999999, float(M.MAX_ZOOM))
    kind = layers.schema[by].dataType.simpleString()

    def stops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [sorted(set().union(*(zoom_stops(json.loads(v)) for v in texts if v))) for texts in zip(p["layout"], p["paint"], p["filter"], strict=True)]
            yield pd.DataFrame({by: p[by], "stops": found})

    rows = layers.select(by, "layout", "paint", "filter").mapInPandas(stops, f"`{by}` {kind}, stops array<double>")
    inside = F.filter("stops", lambda s: s.between(low, high))
    near = F.flatten(F.transform(inside, lambda s: F.array(F.greatest(F.lit(low), s - 0.000001), s, F.least(F.lit(high), s + 0.000001))))
    zooms = rows.select(by, F.explode(F.concat(F.array(F.lit(low), F.lit(high)), near)).alias("zoom")).distinct()
    return zooms.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("zoom"))).filter(F.col("rank") <= most).select(by, "rank", "zoom")
