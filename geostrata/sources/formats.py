"""Rasters and coverages as data sources: ``spark.read.format("geostrata_raster")`` and ``"geostrata_coverage"``.

``register(spark)`` makes them known. Only headers are read to plan a scan; a window given
by options decides which blocks are read at all. Filters aren't pushed into the readers:
Spark 4.1 keeps those of one plan for later plans of the same DataFrame, which then lack
rows without an error.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geostrata.sources.coverage import arc_rows, table_rows
from geostrata.sources.tiff import CELLS, Block, _at, decode, directories, meets, opened, overview

#: Bytes of neighbouring blocks that one partition reads, at least.
TOGETHER = 4 << 20
#: More files than this are planned by file: their headers are read by the tasks.
PLANNED = 1000
_ALL = 1 << 62


def found(path: str, pattern: str) -> list[str]:
    """Files at or below a path, sorted; their store must be one that pyarrow opens."""
    system, place = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else "file://" if path.startswith("file:") else ""
    if system.get_file_info(place).type == fs.FileType.File:
        return [prefix + place]
    files = system.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted(prefix + f.path for f in files if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


def span(text: str | None) -> tuple[int, int]:
    """First number and number after the last of ``first:end``; an end that is left out has no bound."""
    first, _, end = (text or ":").partition(":")
    return int(first) if first.strip() else 0, int(end) if end.strip() else _ALL


class BlockPartition(InputPartition):
    """Blocks of one file; none named: those of the file that its reader finds itself."""

    def __init__(self, path: str, blocks: list[tuple] | None):
        self.path, self.blocks = path, blocks


class RasterReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*.tif*")
        self.factor, self.band = float(options.get("factor", "1")), int(options.get("band", "0"))
        self.nodata = float(options["nodata"]) if "nodata" in options else None
        self.rows, self.cols = span(options.get("rows")), span(options.get("cols"))

    def _blocks(self, path: str) -> list[Block]:
        with opened(path) as f:
            images = directories(f)
        box = (self.rows[0], self.cols[0], self.rows[1] - self.rows[0], self.cols[1] - self.cols[0])
        if min(box[2:]) <= 0:
            return []
        return [b for b in images[overview(images, self.factor)].blocks if meets(b, *box)]

    def partitions(self) -> list[BlockPartition]:
        files = found(self.path, self.pattern)
        if len(files) > PLANNED:
            return [BlockPartition(p, None) for p in files]
        out = []
        for p in files:
            part, size = [], 0
            for b in self._blocks(p):
                part.append(tuple(b))
                size += b.size
                if size >= TOGETHER:
                    out.append(BlockPartition(p, part))
                    part, size = [], 0
            if part:
                out.append(BlockPartition(p, part))
        return out or [BlockPartition("", [])]

    def read(self, partition: BlockPartition) -> Iterator[pa.RecordBatch]:
        blocks = self._blocks(partition.path) if partition.blocks is None else [Block(*b) for b in partition.blocks]
        if not blocks:
            return
        with opened(partition.path) as f:
            for b in blocks:
                cells = decode(_at(f, b.offset, b.size), b)[..., self.band]
                step = max(1, CELLS // max(b.cols, 1))
                for r in range(0, b.rows, step):
                    part = cells[r : r + step].astype("float64")
                    at, by = b.row + r, b.col
                    top, left = max(0, self.rows[0] - at), max(0, self.cols[0] - by)
                    part = part[top : max(top, self.rows[1] - at), left : max(left, self.cols[1] - by)]
                    rows, cols = np.indices(part.shape)
                    value = part.ravel()
                    bad = np.isnan(value) if self.nodata is None else np.isnan(value) | (value <= self.nodata)
                    arrays = [pa.array([partition.path] * len(value)), pa.array((rows + at + top).ravel()), pa.array((cols + by + left).ravel()), pa.array(value, mask=bad)]
                    yield pa.record_batch(arrays, names=["path", "row", "col", "value"])


class RasterSource(DataSource):
    """path, row, col and value of TIFF files.

    Options: path, pattern, factor (picks an overview), band, nodata (values at or below it, and NaN, are null), rows and
    cols (``first:end``, a window of the image that is read).
    """

    @classmethod
    def name(cls) -> str:
        return "geostrata_raster"

    def schema(self) -> str:
        return "path string, row bigint, col bigint, value double"

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)


class CoverageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern, self.kind = options["path"], options.get("pattern", "*.[eE]00"), options.get("kind", "arcs")
        self.table = options.get("table")

    def partitions(self) -> list[BlockPartition]:
        return [BlockPartition(p, None) for p in found(self.path, self.pattern)] or [BlockPartition("", None)]

    def read(self, partition: BlockPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        with opened(partition.path) as f:
            frame = (table_rows if self.kind == "tables" else arc_rows)(f.read())
        if self.table is not None:
            frame = frame[frame["name"] == self.table]
        for row in frame.itertuples(index=False):
            yield (partition.path, *row)


class CoverageSource(DataSource):
    """Arcs (kind ``arcs``) or attribute tables (``tables``) of exchange files, a partition each. Options: path, pattern, kind, table (the name of the only one wanted)."""

    @classmethod
    def name(cls) -> str:
        return "geostrata_coverage"

    def schema(self) -> str:
        from geostrata.sources.coverage import ARC_SCHEMA, TABLE_SCHEMA

        return "path string, " + (TABLE_SCHEMA if self.options.get("kind", "arcs") == "tables" else ARC_SCHEMA)

    def reader(self, schema) -> CoverageReader:
        return CoverageReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session."""
    for source in (RasterSource, CoverageSource):
        spark.dataSource.register(source)
