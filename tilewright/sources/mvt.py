"""Encoded vector tiles: blobs by tile, decoded to one row a feature, and encoded from features.

Decoding fails closed: a tile that breaks a rule gives one row with an `error` and no features, never some of its features.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of a tile. Bytes of a name, a key and a text; the number of layers, features, keys, values, properties (of a tile and of a feature) and points.
MOST = {"name": 1024, "key": 1024, "text": 16384, "layers": 256, "features": 200_000, "keys": 65_536, "values": 262_144, "properties": 2_000_000, "of_feature": 1024, "points": 500_000}
MOST_BYTES, NO_AREA, EXTENT = 4 << 20, 1e-15, 4096
KINDS = {1: ("Point", "MultiPoint"), 2: ("LineString", "MultiLineString"), 3: ("Polygon", "MultiPolygon")}

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POINTS = T.ArrayType(POINT)
VALUE = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("s", T.StringType()), ("d", T.DoubleType()), ("i", T.LongType()), ("u", T.DecimalType(20, 0)), ("b", T.BooleanType()))])
FEATURE = T.StructType([T.StructField(n, t) for n, t in (
    ("source_id", T.LongType()), ("z", T.IntegerType()), ("x", T.IntegerType()), ("y", T.IntegerType()), ("feature_seq", T.IntegerType()), ("source_layer", T.StringType()), ("geometry_type", T.StringType()),
    ("points", POINTS), ("lines", T.ArrayType(POINTS)), ("polygons", T.ArrayType(T.ArrayType(POINTS))), ("props", T.MapType(T.StringType(), VALUE)), ("error", T.StringType()))])


class TileError(ValueError):
    """The tile breaks a rule."""


def read_tile_blobs(spark: SparkSession, path: str, *, pattern: str = r"(\d+)/(\d+)/(\d+)/(\d+)\.[A-Za-z0-9.]+$", most: int = MOST_BYTES) -> DataFrame:
    """(source_id, z, x, y, content, error) of files whose paths hold source, zoom, x and y. Files over `most` bytes have an error and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = [F.regexp_extract("path", pattern, k) for k in range(1, 5)]
    rows = files.filter(F.col("path").rlike(pattern)).select(part[0].cast("long").alias("source_id"), *[p.cast("int").alias(n) for p, n in zip(part[1:], "zxy", strict=True)], "content", "length")
    return checked_blobs(rows, most=most).drop("length")


def checked_blobs(blobs: DataFrame, *, most: int = MOST_BYTES, content: str = "content") -> DataFrame:
    """blobs with `error`; those over `most` bytes lose their content."""
    big = F.octet_length(content) > most
    return blobs.withColumn("error", F.when(big, "the tile is too large")).withColumn(content, F.when(~F.coalesce(big, F.lit(False)), F.col(content)))


class Reader:
    """Fields of a message."""

    def __init__(self, data: memoryview) -> None:
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            if self.at >= len(self.data):
                raise TileError("the tile ends inside a number")
            b = self.data[self.at]
            self.at += 1
            if shift == 63 and b > 1:
                raise TileError("a number is too large")
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def bytes(self, n: int) -> memoryview:
        if n > len(self.data) - self.at:
            raise TileError("a field is longer than the tile")
        self.at += n
        return self.data[self.at - n : self.at]

    def fields(self) -> Iterator[tuple[int, int, Any]]:
        """(number, wire type, value): a number, or the bytes of what has a length or a fixed size."""
        while self.at < len(self.data):
            tag = self.varint()
            number, wire = tag >> 3, tag & 7
            if not 0 < number < 1 << 31:
                raise TileError("a field's number is not valid")
            if wire == 0:
                yield number, wire, self.varint()
            elif wire in (1, 2, 5):
                yield number, wire, self.bytes({1: 8, 5: 4}.get(wire) or self.varint())
            else:
                raise TileError("a field's wire type is not valid")


def varints(data: memoryview) -> list[int]:
    """All numbers of a packed field."""
    out, v, shift = [], 0, 0
    for b in bytes(data):
        if shift == 63 and b > 1:
            raise TileError("a number is too large")
        v |= (b & 0x7F) << shift
        if b < 0x80:
            out.append(v)
            v = shift = 0
        else:
            shift += 7
    if shift:
        raise TileError("the tile ends inside a number")
    return out


def text_of(data: memoryview, most: int, what: str) -> str:
    if len(data) > most:
        raise TileError(f"a {what} is too long")
    try:
        return bytes(data).decode("utf-8")
    except UnicodeDecodeError:
        raise TileError(f"a {what} is not valid UTF-8") from None


def value_of(data: memoryview) -> dict[str, Any]:
    found: list[dict[str, Any]] = []
    for number, wire, v in Reader(data).fields():
        made = None
        if (number, wire) == (1, 2):
            made = ("string", "s", text_of(v, MOST["text"], "text"))
        elif (number, wire) == (2, 5):
            made = ("float", "d", struct.unpack("<f", v)[0])
        elif (number, wire) == (3, 1):
            made = ("double", "d", struct.unpack("<d", v)[0])
        elif (number, wire) == (4, 0):
            made = ("int", "i", v - (v >> 63 << 64))
        elif (number, wire) == (5, 0):
            made = ("uint", "u", Decimal(v))
        elif (number, wire) == (6, 0):
            made = ("sint", "i", (v >> 1) ^ -(v & 1))
        elif (number, wire) == (7, 0):
            made = ("bool", "b", v != 0)
        if made:
            found.append({"kind": made[0], made[1]: made[2]})
    if len(found) != 1:
        raise TileError("a value has no type that is supported" if not found else "a value has several types")
    return found[0]


def parts_of(data: list[memoryview], kind: int, extent: int) -> Iterator[tuple[str, list[tuple[float, float]]]]:
    """Commands of a geometry: (move, line or close, points). A geometry has a few points most often, for which plain numbers take less time than arrays."""
    x = y = 0
    for v in map(varints, data):
        at = 0
        while at < len(v):
            command, n = v[at] & 7, v[at] >> 3
            at += 1
            if n == 0 or command not in ((1,) if kind == 1 else (1, 2) if kind == 2 else (1, 2, 7)) or (command == 1 and kind != 1 and n != 1) or (command == 7 and n != 1):
                raise TileError("a geometry's command is not valid")
            if command == 7:
                yield "close", []
                continue
            if at + 2 * n > len(v):
                raise TileError("the tile ends inside a number")
            moved = [(m >> 1) ^ -(m & 1) for m in v[at : at + 2 * n]]
            at += 2 * n
            if max(moved) > 1 << 31 or min(moved) < -1 << 31:
                raise TileError("a step is too large")
            where = []
            for dx, dy in zip(moved[::2], moved[1::2], strict=True):
                x, y = x + dx, y + dy
                if not (-1 << 31 < x < 1 << 31 and -1 << 31 < y < 1 << 31):
                    raise TileError("a position is too large")
                where.append((x / extent, y / extent))
            yield ("move" if command == 1 else "line"), where


def signed_area(p: list[tuple[float, float]]) -> float:
    total, (a, b) = 0.0, p[-1]
    for x, y in p:
        total += a * y - x * b
        a, b = x, y
    return total / 2


def geometry_of(data: list[memoryview], kind: int, extent: int, budget: list[int]) -> dict[str, list]:
    points: list[tuple[float, float]] = []
    lines: list[list[tuple[float, float]]] = []
    polygons: list[list[list[tuple[float, float]]]] = []
    ring: list[tuple[float, float]] | None = None
    for what, p in parts_of(data, kind, extent):
        budget[0] += len(p)
        if budget[0] > MOST["points"]:
            raise TileError("the tile has too many points")
        if kind == 1:
            points += p
        elif kind == 2:
            if what == "move":
                lines.append(p)
            elif not lines:
                raise TileError("a line has no start")
            else:
                lines[-1] += p
        elif what == "move":
            if ring is not None:
                raise TileError("a ring is not closed")
            ring = p
        elif ring is None:
            raise TileError("a ring has no start")
        elif what == "line":
            ring += p
        else:
            whole, ring = ring, None
            if len(whole) < 3:
                raise TileError("a ring has fewer than three points")
            area = signed_area(whole)
            if abs(area) <= NO_AREA:
                raise TileError("a ring has no area")
            if area > 0:
                polygons.append([])
            elif not polygons:
                raise TileError("a polygon starts with a hole")
            polygons[-1].append(whole)
    if ring is not None:
        raise TileError("a ring is not closed")
    if any(len(p) < 2 for p in lines):
        raise TileError("a line has fewer than two points")
    out = {"points": points, "lines": lines, "polygons": polygons}
    if not any(out.values()):
        raise TileError("a feature has no geometry")
    return out


def features_of(tile: bytes) -> Iterator[dict[str, Any]]:
    """The features of a tile, in order. What a layer is called and holds may come after its features."""
    count = dict.fromkeys(MOST, 0)
    budget = [0]

    def more(what: str, n: int = 1) -> None:
        count[what] += n
        if count[what] > MOST[what]:
            raise TileError(f"the tile has too many {what}")

    for number, wire, layer in Reader(memoryview(tile)).fields():
        if (number, wire) != (3, 2):
            continue
        more("layers")
        name, extent, keys, values, features = "", EXTENT, [], [], []
        for n, w, v in Reader(layer).fields():
            if (n, w) == (1, 2):
                name = text_of(v, MOST["name"], "layer's name")
            elif (n, w) == (2, 2):
                more("features")
                features.append(v)
            elif (n, w) == (3, 2):
                more("keys")
                keys.append(text_of(v, MOST["key"], "key"))
            elif (n, w) == (4, 2):
                more("values")
                values.append(value_of(v))
            elif (n, w) == (5, 0):
                extent = v
        if not name or not 0 < extent < 1 << 32:
            raise TileError("a layer has no name or no extent")
        for f in features:
            kind, tags, data = 0, [], []
            for n, w, v in Reader(f).fields():
                if (n, w) == (3, 0):
                    kind = v
                elif n == 2:
                    if w not in (0, 2):
                        raise TileError("a tag's wire type is not valid")
                    tags += varints(v) if w == 2 else [v]
                elif (n, w) == (4, 2):
                    data.append(v)
            if kind not in KINDS:
                continue
            if len(tags) % 2 or len(tags) // 2 > MOST["of_feature"]:
                raise TileError("a feature's tags are no pairs, or too many")
            more("properties", len(tags) // 2)
            if any(k >= len(keys) for k in tags[::2]) or any(v >= len(values) for v in tags[1::2]):
                raise TileError("a tag is out of range")
            shape = geometry_of(data, kind, extent, budget)
            n = len(shape[("points", "lines", "polygons")[kind - 1]])
            # Of equal keys the last one counts.
            yield {"source_layer": name, "geometry_type": KINDS[kind][n > 1], **shape, "props": {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}}


def lists(rows: list[list], type_: pa.DataType) -> pa.Array:
    """Lists of points, at any depth, without an object for each point. No row is null."""
    if pa.types.is_struct(type_):
        return pa.StructArray.from_arrays([pa.array([p[k] for p in rows], pa.float64()) for k in (0, 1)], fields=list(type_))
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([*map(len, rows)], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), lists([v for r in rows for v in r], type_.value_type), type=type_)


def feature_batch(keys: list[tuple], features: list[dict[str, Any]], schema: pa.Schema) -> pa.RecordBatch:
    """Features, each with its tile's key and its number in it, as FEATURE rows without an error."""
    at = schema.field("props").type
    props = [f["props"] for f in features]
    ends = np.zeros(len(props) + 1, np.int32)
    np.cumsum([*map(len, props)], out=ends[1:])
    values = [v for p in props for v in p.values()]
    value = pa.StructArray.from_arrays([pa.array([v.get(f.name) for v in values], f.type) for f in at.item_type], fields=list(at.item_type))
    made = {"props": pa.MapArray.from_arrays(pa.array(ends), pa.array([k for p in props for k in p], at.key_type), value, type=at), "error": pa.nulls(len(features), pa.string())}
    made |= dict(zip(("source_id", "z", "x", "y", "feature_seq"), zip(*keys, strict=True), strict=True)) | {c: [f[c] for f in features] for c in ("source_layer", "geometry_type")}
    made |= {c: lists([f[c] for f in features], schema.field(c).type) for c in ("points", "lines", "polygons")}
    return pa.RecordBatch.from_arrays([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in schema], schema=schema)


#: Features that leave a task together, of one tile or of many.
TOGETHER = 2000


def decode_vector_tiles(tiles: DataFrame) -> DataFrame:
    """FEATURE rows of tiles (source_id, z, x, y, content[, error]): one a feature, feature_seq in the order of the tile. A tile with an error has one row, of its error; a null or empty tile has none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(FEATURE)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, features, failed, size = [], [], [], 0
        for b in batches:
            for *key, content, error in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4), b.column(5).to_pylist(), strict=True):
                if error is None:
                    try:
                        found = [*features_of(content.as_py() or b"")]  # a tile at a time: what it holds is far larger than its bytes
                    except TileError as e:
                        error = str(e)
                if error is not None:
                    failed.append(dict(zip(("source_id", "z", "x", "y"), key, strict=True)) | {"error": error})
                    if len(failed) == TOGETHER:
                        yield pa.RecordBatch.from_pylist(failed, schema)
                        failed = []
                    continue
                keys += [(*key, k) for k in range(len(found))]
                features += found
                size += len(content.as_buffer()) if content.is_valid else 0
                if len(features) >= TOGETHER or size >= MOST_BYTES:
                    for k in range(0, len(features), TOGETHER):
                        yield feature_batch(keys[k : k + TOGETHER], features[k : k + TOGETHER], schema)
                    keys, features, size = [], [], 0
        if features:
            yield feature_batch(keys, features, schema)
        if failed:
            yield pa.RecordBatch.from_pylist(failed, schema)

    error = F.col("error") if "error" in tiles.columns else F.lit(None).cast("string")
    ins = tiles.select(F.col("source_id").cast("long").alias("source_id"), *[F.col(c).cast("int").alias(c) for c in "zxy"], "content", error.alias("error"))
    return ins.mapInArrow(decoded, FEATURE)


@lru_cache(1 << 15)
def number(v: int) -> bytes:
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def field(n: int, data: bytes) -> bytes:
    return number(n << 3 | 2) + number(len(data)) + data


def zig(v: int) -> bytes:
    return number((v << 1) ^ (v >> 63))


def encoded_value(v: Any) -> bytes:
    if isinstance(v, bool):
        return number(7 << 3) + number(int(v))
    if isinstance(v, int):
        return number(6 << 3) + zig(v)
    if isinstance(v, float):
        return number(3 << 3 | 1) + struct.pack("<d", v)
    return field(1, str(v).encode())


def encoded_geometry(kind: str, parts: list[list[tuple[int, int]]]) -> bytes:
    """parts: the points, the lines, or the rings, each point as a step from the one before."""
    out = b""
    for part in [[p for q in parts for p in q]] if kind == "Point" else parts:
        if not part:
            raise ValueError("a part has no points")
        moved = [zig(a) + zig(b) for a, b in part]
        out += number(len(part) << 3 | 1) + b"".join(moved) if kind == "Point" else number(9) + moved[0] + number(len(part) - 1 << 3 | 2) + b"".join(moved[1:])
        out += number(15) if kind == "Polygon" else b""
    return field(4, out)


def steps_of(parts: pa.ListArray, extent: int) -> list[list[list[tuple[int, int]]]]:
    """Of each row's parts, their points in whole numbers of the tile's grid, each as a step from the row's point before; of all rows at once."""
    inner = parts.flatten()
    n_parts, n_points = (pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in (parts, inner))
    points = inner.flatten()
    at = [points.flatten()[points.type.get_field_index(c)].to_numpy(zero_copy_only=False) * extent for c in "xy"]
    if not all(np.isfinite(c).all() for c in (n_parts, n_points, *at)):
        raise ValueError("a feature has no parts, or a point that is no number")
    part_ends, ends = np.cumsum(n_parts, dtype=np.int64), np.cumsum(n_points, dtype=np.int64)
    first = np.append(0, ends)[np.append(0, part_ends)[:-1]]
    steps = [np.rint(c).astype(np.int64) for c in at]
    for k, c in enumerate(steps):
        moved = np.diff(c, prepend=0)
        begin = first[np.append(first[1:], len(c)) > first]
        moved[begin] = c[begin]
        steps[k] = moved
    flat = [*zip(*(c.tolist() for c in steps), strict=True)]
    each = [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
    return [each[a:b] for a, b in zip([0, *part_ends.tolist()], part_ends.tolist(), strict=False)]


class Layer:
    """A layer that is being encoded."""

    def __init__(self) -> None:
        self.keys, self.values, self.body = {}, {}, []

    def add(self, kind: str, parts: list[list[tuple[int, int]]], properties: Iterator[tuple[str, Any]]) -> None:
        tags = b""
        for k, v in properties:
            if v is not None and v == v:
                tags += number(self.keys.setdefault(k, len(self.keys))) + number(self.values.setdefault((type(v), v), len(self.values)))
        self.body.append(field(2, field(2, tags) + number(3 << 3) + number(("Point", "LineString", "Polygon").index(kind) + 1) + encoded_geometry(kind, parts)))

    def encoded(self, name: str, extent: int) -> bytes:
        head = field(1, name.encode()) + number(5 << 3) + number(extent)
        return field(3, head + b"".join(self.body) + b"".join(field(3, k.encode()) for k in self.keys) + b"".join(field(4, encoded_value(v)) for _, v in self.values))


def encode_tiles(features: DataFrame, properties: list[str], *, extent: int = EXTENT) -> DataFrame:
    """(source_id, z, x, y, content): tiles of features (source_id, z, x, y, feature_seq, source_layer, geometry_type, parts: array<array<struct<x,y>>>, properties). Features without a layer are left out.

    Rows are dealt and sorted by tile, and a task encodes its tiles as rows stream by: it holds a batch and one tile, which has a limit of features. The number of partitions is fixed, as
    features are few bytes, of which adaptive execution would make few partitions.
    """
    tile, shape = ["source_id", "z", "x", "y"], ["source_layer", "geometry_type", "parts"]
    schema = pa.schema([("source_id", pa.int64()), *[(c, pa.int32()) for c in "zxy"], ("content", pa.binary())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, layers, done, size = None, {}, [], 0
        for b in batches:
            keys = zip(*(c.to_pylist() for c in b.columns[:4]), strict=True)
            own = [c.to_pylist() for c in b.columns[7:]]
            for key, name, kind, parts, *values in zip(keys, b.column(4).to_pylist(), b.column(5).to_pylist(), steps_of(b.column(6), extent), *own, strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, b"".join(v.encoded(n, extent) for n, v in layers.items())))
                        size += len(done[-1][4])
                    now, layers = key, {}
                if name is not None:
                    layers.setdefault(name, Layer()).add(kind, parts, zip(properties, values, strict=True))
                if len(done) >= TOGETHER or size >= MOST_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                    done, size = [], 0
        if now is not None:
            done.append((*now, b"".join(v.encoded(n, extent) for n, v in layers.items())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    n = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = features.select(F.col("source_id").cast("long").alias("source_id"), *[F.col(c).cast("int").alias(c) for c in "zxy"], F.col("source_layer").cast("string").alias("source_layer"), *shape[1:], *[F.col(p).alias(f"_p{k}") for k, p in enumerate(properties)], F.col("feature_seq").alias("_seq"))
    rows = rows.repartition(n, *tile).sortWithinPartitions(*tile, "_seq").drop("_seq")
    return rows.mapInArrow(encoded, "source_id long, z int, x int, y int, content binary")
