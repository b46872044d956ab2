"""Table functions for SQL over contents of files. ``register(spark)`` names them.

Records come by lateral join, a call a file: ``FROM files, LATERAL dbase_rows(content)``. Cells come in Arrow batches from
a table of files with columns path and content: ``FROM png_cells(TABLE(files))``; Spark 4.1 has no lateral join for those.
A null content gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from geostrata.sources import binary
from geostrata.sources.tiff import tiff


@udtf(returnType="record int, attributes map<string,string>")
class DbaseRows:
    """Records of a dBASE table by their number from 0, values as texts; a deleted one has null attributes."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for i, row in enumerate(binary.dbase(bytes(content)) if content is not None else []):
            yield i, None if row is None else {k: None if v is None else str(v) for k, v in row.items()}


@udtf(returnType="record int, part int, points array<struct<x: double, y: double>>")
class ShapeParts:
    """Parts of the shapes of a shapefile by number of record and part; a null shape is one row without points."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for i, shape in enumerate(binary.shapes(bytes(content)) if content is not None else []):
            for j, part in enumerate(shape or [None]):
                yield i, j, None if part is None else [(float(x), float(y)) for x, y in part]


def _cells(files: pa.RecordBatch, decode, names: tuple[str, ...], kind: pa.DataType) -> Iterator[pa.Table]:
    for path, data in zip(files.column("path").to_pylist(), files.column("content").to_pylist(), strict=True):
        if data is None:
            continue
        values = decode(data)
        planes = values.reshape(*values.shape[:2], -1)
        rows, cols = np.indices(planes.shape[:2])
        own = {n: pa.array(planes[..., min(i, planes.shape[2] - 1)].ravel(), kind) for i, n in enumerate(names)}
        yield pa.table({"path": pa.array([path] * rows.size, pa.string()), "row": pa.array(rows.ravel(), pa.int32()), "col": pa.array(cols.ravel(), pa.int32()), **own})


@arrow_udtf(returnType="path string, row int, col int, red int, green int, blue int")
class PngCells:
    """Cells of PNG images; a grey one has three equal colours."""

    def eval(self, files: pa.RecordBatch) -> Iterator[pa.Table]:
        yield from _cells(files, binary.png, ("red", "green", "blue"), pa.int32())


@arrow_udtf(returnType="path string, row int, col int, value double")
class TiffCells:
    """Cells of the full images of TIFF files, first band."""

    def eval(self, files: pa.RecordBatch) -> Iterator[pa.Table]:
        yield from _cells(files, lambda data: tiff(data).astype("float64"), ("value",), pa.float64())


FUNCTIONS = {"dbase_rows": DbaseRows, "shape_parts": ShapeParts, "png_cells": PngCells, "tiff_cells": TiffCells}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
