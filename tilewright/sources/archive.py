"""Tiles packed in archives: data files of many tiles, and a directory that says where each lies.

The directory is a Parquet table, in order of source, zoom and place; data files are written by the tasks that write it, and count only if their rows are in it, so what lost or
repeated tasks leave behind is never read. Reading is a data source of its own, which takes ranges of source, zoom, x and y as an option. When a scan is planned, only the statistics of the
directory's row groups are looked at, and groups that cannot match are no partition; tasks read their group's rows, filter them, and fetch neighbouring tiles together.

Ranges are an option, and not pushed filters: Spark 4.1 keeps what one plan has pushed to a Python source for later plans of the same table, which would lose rows there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilewright.operators.staging import written

TILE = ["source_id", "z", "x", "y"]
SCHEMA = "source_id long, z int, x int, y int, content binary"
#: Tiles that lie no further apart are fetched together, up to so many bytes.
GAP, FETCH = 1 << 16, 8 << 20
#: Names that clusters give to stores, and those by which pyarrow knows them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    scheme, colon, rest = uri.partition("://")
    return pa.fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest) if colon else (pa.fs.LocalFileSystem(), uri)


def write_tile_archive(blobs: DataFrame, folder: str, *, group_bytes: int = 1 << 20) -> None:
    """Writes tiles (source_id, z, x, y, content) below folder, in order of source, zoom and place. Tiles without content are left out; one that is there twice is twice in the archive."""
    n = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = f"{uuid.uuid4().hex}.tiles", None, 0
        for b in batches:
            places = []
            for content in b.column(4):
                if out is None:
                    fs, path = opened(folder)
                    fs.create_dir(f"{path}/data", recursive=True)
                    out = fs.open_output_stream(f"{path}/data/{name}")
                data = content.as_buffer()
                out.write(data)
                places.append((at, data.size))
                at += data.size
            offset, length = zip(*places, strict=True) if places else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([name] * len(places), pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=[*TILE, "file", "offset", "length"])
        if out is not None:
            out.close()

    # Written first: ranges are told by a pass over the rows, for which tiles would be made twice.
    rows = written(blobs.filter("content IS NOT NULL").select(F.col("source_id").cast("long"), *[F.col(c).cast("int") for c in "zxy"], "content"), "tiles").repartitionByRange(n, *TILE).sortWithinPartitions(*TILE)
    directory = rows.mapInArrow(packed, "source_id long, z int, x int, y int, file string, offset long, length long")
    directory.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(f"{folder}/directory")


@dataclass
class Group(InputPartition):
    """A row group of the directory."""

    file: str
    number: int


class TileArchiveReader(DataSourceReader):
    def __init__(self, folder: str, ranges: dict[str, tuple[int | None, int | None]]) -> None:
        self.folder, self.ranges = folder, ranges

    def may_hold(self, low: dict[str, int], high: dict[str, int]) -> bool:
        """Whether a group with values from low to high may hold a tile in all ranges."""
        return all((a is None or high[c] >= a) and (b is None or low[c] <= b) for c, (a, b) in self.ranges.items() if c in low)

    def partitions(self) -> list[Group]:
        fs, path = opened(self.folder)
        out = []
        for f in sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(f"{path}/directory")) if f.path.endswith(".parquet")):
            with fs.open_input_file(f) as source:
                meta = pq.read_metadata(source)
            for k in range(meta.num_row_groups):
                stats = {c.path_in_schema: c.statistics for c in (meta.row_group(k).column(i) for i in range(4)) if c.statistics is not None and c.statistics.has_min_max}
                if self.may_hold({c: s.min for c, s in stats.items()}, {c: s.max for c, s in stats.items()}):
                    out.append(Group(f.rpartition("/")[2], k))
        return out

    def read(self, partition: Group | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no group can match
            return
        fs, path = opened(self.folder)
        with fs.open_input_file(f"{path}/directory/{partition.file}") as source:
            rows = pq.ParquetFile(source).read_row_group(partition.number)
        for column, (low, high) in self.ranges.items():
            for bound, test in ((low, pc.greater_equal), (high, pc.less_equal)):
                rows = rows if bound is None else rows.filter(test(rows[column], bound))
        rows = rows.sort_by([("file", "ascending"), ("offset", "ascending")])
        files, offsets, lengths = (rows[c].to_pylist() for c in ("file", "offset", "length"))
        schema = pa.schema([("source_id", pa.int64()), ("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("content", pa.binary())])
        i = 0
        while i < len(files):
            j, end = i + 1, offsets[i] + lengths[i]
            while j < len(files) and files[j] == files[i] and offsets[j] - end <= GAP and offsets[j] + lengths[j] - offsets[i] <= FETCH:
                end, j = offsets[j] + lengths[j], j + 1
            with fs.open_input_file(f"{path}/data/{files[i]}") as data:
                run = data.read_at(end - offsets[i], offsets[i])
            content = pa.array([run[a - offsets[i] : a - offsets[i] + n] for a, n in zip(offsets[i:j], lengths[i:j], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[rows[c].slice(i, j - i).combine_chunks().cast(schema.field(c).type) for c in TILE], content], schema=schema)
            i = j


class TileArchive(DataSource):
    """format("tile_archive").load(folder); option ranges: a JSON object of columns, each with its first and last value, or null for none."""

    @classmethod
    def name(cls) -> str:
        return "tile_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return TileArchiveReader(self.options["path"], {c: tuple(r) for c, r in json.loads(self.options.get("ranges", "{}")).items()})


def read_tile_archive(spark: SparkSession, folder: str, **ranges: tuple[int | None, int | None]) -> DataFrame:
    """(source_id, z, x, y, content) of the tiles of an archive whose source_id, z, x and y lie in the ranges given: (first, last), each of which may be None."""
    if unknown := set(ranges) - set(TILE):
        raise ValueError(f"no columns of a tile: {sorted(unknown)}")
    spark.dataSource.register(TileArchive)
    return spark.read.format("tile_archive").option("ranges", json.dumps(ranges)).load(folder)
