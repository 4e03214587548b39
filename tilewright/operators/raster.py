"""Raster tiles as rows of pixel buffers (blue, green, red, alpha bytes): compositing, stitching and cropping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.tiles import TILE


#: Tiles that are put out together, a few megabytes, and so many bytes of small ones.
ROWS, BYTES = 64, 4 << 20


def composited(below: bytes, above: bytes) -> bytes:
    """above over below, by its alpha; opaque."""
    a, b = (np.frombuffer(v, np.uint8).reshape(-1, 4).astype(np.int32) for v in (above, below))
    alpha = a[:, 3:]
    out = (a * alpha + b * (255 - alpha) + 127) // 255
    out[:, 3] = 255
    return out.astype(np.uint8).tobytes()


def composite_tiles(background: DataFrame, overlay: DataFrame) -> DataFrame:
    """(source_id, z, x, y, pixels, error): tiles of both tables (TILE, pixels) that share a number. Buffers of different sizes, or of no whole pixels, give an error."""
    met = background.select(*TILE, F.col("pixels").alias("_b")).join(overlay.select(*TILE, F.col("pixels").alias("_o")), TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                rows = b.slice(k, ROWS)
                pairs = [(x.as_buffer() if x.is_valid else None, y.as_buffer() if y.is_valid else None) for x, y in zip(rows.column(4), rows.column(5), strict=True)]
                good = [x is not None and y is not None and x.size == y.size and not x.size % 4 for x, y in pairs]
                # All tiles at once: a pixel's place does not matter.
                whole = [p for p, ok in zip(pairs, good, strict=True) if ok]
                done, ends = composited(*[b"".join(p[k] for p in whole) for k in (0, 1)]), np.cumsum([p[0].size for p in whole]).tolist()
                tiles = iter([done[a:z] for a, z in zip([0, *ends], ends, strict=False)])
                pixels = pa.array([next(tiles) if ok else None for ok in good], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns[:4], pixels, pa.array([None if ok else "the buffers do not match" for ok in good], pa.string())], names=[*TILE, "pixels", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    return met.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in TILE) + ", pixels binary, error string")


def stitch_tiles(children: DataFrame, levels: int, size: int) -> DataFrame:
    """(source_id, z, x, y, pixels, error): tiles `levels` above children (TILE, pixels) that are scaled already, row by row into a tile of size x size pixels. A parent without all of its
    4**levels children, or with one of another size, has an error. A parent is a group of that many tiles."""
    side = 1 << levels
    part = size // side
    up = lambda c: F.call_function("shiftright", c, F.lit(levels)).alias(c)
    mask = side - 1
    rows = children.select("source_id", (F.col("z") - levels).alias("z"), up("x"), up("y"), F.col("x").bitwiseAND(mask).alias("dx"), F.col("y").bitwiseAND(mask).alias("dy"), "pixels").filter("z >= 0")

    n, length = side * side, part * part * 4
    place = F.col("dy") * side + F.col("dx")
    by = rows.groupBy(*TILE).agg(F.count("*").alias("_n"), F.count_if(F.octet_length("pixels") == length).alias("_whole"), F.size(F.collect_set(place)).alias("_places"), F.collect_list(F.struct(place.alias("k"), "pixels")).alias("_kids"))
    good = (F.col("_n") == n) & (F.col("_whole") == n) & (F.col("_places") == n)
    lists = by.select(*TILE, F.when(good, F.array_sort("_kids")["pixels"]).alias("kids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                some = b.slice(k, ROWS)
                kids = some.column(4)
                whole = kids.is_valid().to_numpy(zero_copy_only=False)
                # Of all tiles at once: children by rows and columns, and their own rows before the columns of children.
                joined = np.frombuffer(b"".join(kids.drop_null().flatten().to_pylist()), np.uint8).reshape(-1, side, side, part, part * 4)
                tiles = iter(joined.transpose(0, 1, 3, 2, 4).reshape(len(joined), -1))
                pixels = pa.array([next(tiles).tobytes() if ok else None for ok in whole], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pixels, pa.array([None if ok else "children are missing or of another size" for ok in whole], pa.string())], names=[*TILE, "pixels", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return lists.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in TILE) + ", pixels binary, error string")


def crop_overzoom(parents: DataFrame, tiles: DataFrame) -> DataFrame:
    """(source_id, z, x, y, parent_z, width, height, scale_x, scale_y, shift_x, shift_y, pixels, error): for tiles the part of the tile above them (TILE, width, height, pixels) that they
    show, with a pixel more at every side that has one, and the scale and shift that take a tile's own square to it. The nearest tile above counts. A part of no whole pixel is an error."""
    from tilewright.operators.tiles import ancestors

    up = ancestors(tiles.select(*TILE), "source_id").filter(F.col("az") < F.col("z"))
    met = up.join(parents.select("source_id", F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay")), ["source_id", "az", "ax", "ay"])
    # The nearest parent is picked before any pixels move.
    near = met.groupBy(*TILE).agg(F.max("az").alias("az")).withColumns({c: F.call_function("shiftright", c[1], F.col("z") - F.col("az")) for c in ("ax", "ay")})
    rows = near.join(parents.select("source_id", F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("width").alias("_w"), F.col("height").alias("_h"), "pixels"), ["source_id", "az", "ax", "ay"])
    names = [*TILE, "parent_z", "width", "height", "scale_x", "scale_y", "shift_x", "shift_y", "pixels", "error"]

    def cropped(p: pd.DataFrame) -> pd.DataFrame:
        """Tiles that show the same part of parents of one size are cut at once."""
        scale = 2 ** (p["z"] - p["az"])
        w, h = p["w_"] // scale, p["h_"] // scale
        bad = (w < 1) | (h < 1) | (p["pixels"].str.len() != p["w_"] * p["h_"] * 4)
        out = p[TILE].assign(parent_z=p["az"], **dict.fromkeys(names[5:12], None), error=np.where(bad, "the tile above is too small", None))
        parts = pd.DataFrame({"pw": p["w_"], "ph": p["h_"], "w": w, "h": h, "x": p["x"] % scale * w, "y": p["y"] % scale * h})[~bad].reset_index(names="_at")
        made = []
        for (pw, ph, w, h, x, y), group in parts.groupby(["pw", "ph", "w", "h", "x", "y"], sort=False)["_at"]:
            left, top, right, bottom = max(0, x - 1), max(0, y - 1), min(pw, x + w + 1), min(ph, y + h + 1)
            cut = np.frombuffer(b"".join(p["pixels"].loc[group]), np.uint8).reshape(-1, ph, pw, 4)[:, top:bottom, left:right]
            wide, high = right - left, bottom - top
            made.append(pd.DataFrame({"width": wide, "height": high, "scale_x": w / wide, "scale_y": h / high, "shift_x": (x - left) / wide, "shift_y": (y - top) / high, "pixels": [c.tobytes() for c in cut]}, index=group.to_numpy()))
        if made:
            out[names[5:12]] = pd.concat(made).reindex(out.index)
        return out[names].replace({np.nan: None}) if bad.any() else out[names]

    def crop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                step = max(ROWS, BYTES // max(1, int(p["pixels"].str.len().max())))
                for k in range(0, len(p), step):
                    yield cropped(p.iloc[k : k + step].reset_index(drop=True))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.select(*TILE, "az", F.col("_w").alias("w_"), F.col("_h").alias("h_"), "pixels")
    return out.mapInPandas(crop, ", ".join(f"{c} {kinds[c]}" for c in TILE) + ", parent_z int, width int, height int, scale_x double, scale_y double, shift_x double, shift_y double, pixels binary, error string")
