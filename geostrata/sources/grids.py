"""Flat 16-bit grids with a JSON sidecar beside each, and copies of file trees. Tasks read and write the files themselves.

The store must be one that pyarrow opens; on a cluster it must be shared.
"""

from __future__ import annotations

import hashlib
import json
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.sources.tiff import CELLS, opened

NODATA = -32768
SIDECAR = "cols int, rows int, cell_m double, scale double, nodata int, bbox_utm array<double>, sha256 string"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def put_file(path: str, data: bytes) -> None:
    """A whole file or none: it is written beside its place and then moved there, so a repeated task leaves one file."""
    system, place = store(path)
    beside = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as f:
        f.write(data)
    system.move(beside, place)


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, then the fields of the sidecar) of each ``.json`` file; path is that of the grid beside it."""
    meta = spark.read.schema(SIDECAR).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return meta.select(F.regexp_replace("_metadata.file_path", r"\.json$", ".bin").alias("path"), *meta.columns)


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, x, y, value) of the grids whose sidecars lie at ``path``; row 0 is in the north, x and y are centres of cells.

    Values are multiplied by the sidecar's scale (1 if it has none); its no-data code (-32768 if none) is null. Without
    ``bbox_utm`` x and y are null. Bands of rows, not files, are dealt out to tasks. A grid whose file isn't of the size
    that its sidecar states is an error.
    """
    band = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("cols")).cast("int"))
    bands = sidecars(spark, path).where("rows > 0 and cols > 0").select("*", band.alias("band"))
    bands = bands.select("path", "cols", "rows", "band", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.col("band"))).alias("first"), "cell_m", "scale", "nodata", "bbox_utm")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples(index=False):
                with opened(b.path) as f:
                    if f.size() != 2 * b.cols * b.rows:
                        raise ValueError(f"{b.path} has {f.size()} bytes, its sidecar states {b.rows} x {b.cols} cells")
                    f.seek(2 * b.cols * b.first)
                    raw = np.frombuffer(f.read(2 * b.cols * min(b.band, b.rows - b.first)), "<i2")
                row, col = np.divmod(np.arange(raw.size) + b.cols * b.first, b.cols)
                scale, nodata = 1.0 if pd.isna(b.scale) else b.scale, NODATA if pd.isna(b.nodata) else b.nodata
                west, north, cell = (np.nan, np.nan, np.nan) if b.bbox_utm is None else (b.bbox_utm[0], b.bbox_utm[3], b.cell_m)
                value = np.where(raw == nodata, np.nan, raw * scale)
                yield pd.DataFrame({"path": b.path, "row": row, "col": col, "x": west + (col + 0.5) * cell, "y": north - (row + 0.5) * cell, "value": value})

    cells = bands.repartition("path", "first").mapInPandas(run, "path string, row long, col long, x double, y double, value double")
    return cells.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y", "value")})


def write_grids(cells: DataFrame, key: str, folder: str, cols: int, rows: int, cell_m: float, west: float, north: float, scale: float = 1.0) -> DataFrame:
    """Writes (key, row, col, value) as ``<key>.bin`` and ``<key>.json`` and returns key, sha256, low, high and missing of each.

    Codes are value / scale to the nearest integer, ties to even; null and absent cells are no data. A cell outside the
    grid, two values for a cell, or a code that 16 bits don't hold is an error. A grid is built in one task, so a key is a
    tile of bounded size. The files are written when the result is read.
    """

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        name = str(frame["key"].iloc[0])
        if not name or set(name) & set("/\\:") or name.startswith("."):
            raise ValueError(f"{name!r} can't name a file")
        frame = frame.dropna(subset=["value"])
        row, col, code = frame["row"].to_numpy(np.int64), frame["col"].to_numpy(np.int64), np.rint(frame["value"].to_numpy(float) / scale)
        if ((row < 0) | (row >= rows) | (col < 0) | (col >= cols)).any() or (np.abs(code) > 32767).any():
            raise ValueError(f"{name}: a cell or a value lies outside the grid")
        if np.unique(row * cols + col).size != row.size:
            raise ValueError(f"{name}: a cell has two values")
        grid = np.full((rows, cols), NODATA, "<i2")
        grid[row, col] = code
        data = grid.tobytes()
        sha, low, high = hashlib.sha256(data).hexdigest(), *((float(code.min() * scale), float(code.max() * scale)) if code.size else (None, None))
        box = [west, north - rows * cell_m, west + cols * cell_m, north]
        meta = {"cols": cols, "rows": rows, "cell_m": cell_m, "scale": scale, "nodata": NODATA, "bbox_utm": box, "sha256": sha, "range": [low, high]}
        put_file(f"{folder}/{name}.bin", data)
        put_file(f"{folder}/{name}.json", (json.dumps(meta, indent=1) + "\n").encode())
        return pd.DataFrame({"key": [name], "sha256": [sha], "low": [low], "high": [high], "missing": [cols * rows - code.size]})

    system, place = store(folder)
    system.create_dir(place, recursive=True)
    named = cells.select(F.col(key).cast("string").alias("key"), "row", "col", F.col("value").cast("double").alias("value"))
    return named.where("key is not null").groupBy("key").applyInPandas(pack, "key string, sha256 string, low double, high double, missing long")


def copy_files(files: DataFrame, root: str, folder: str) -> DataFrame:
    """Copies the files of a listing (path, length) under ``root`` to the same places under ``folder``; returns path and length of each copy.

    Each file is streamed by one task. With ``within_budget`` before it, nothing is copied unless all files fit the budget.
    The files are written when the result is read.
    """
    base = store(root)[1].rstrip("/") + "/"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = store(folder)
        for frame in frames:
            made = []
            for p in frame["path"]:
                rest = store(p)[1]
                if not rest.startswith(base):
                    raise ValueError(f"{p} isn't under {root}")
                to = f"{place.rstrip('/')}/{rest[len(base):]}"
                beside = f"{to}.{uuid.uuid4().hex}"
                system.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with opened(p) as f, system.open_output_stream(beside) as g:
                    shutil.copyfileobj(f, g, 1 << 20)
                system.move(beside, to)
                made.append((to, system.get_file_info(to).size))
            yield pd.DataFrame(made, columns=["path", "length"])

    return files.select("path").mapInPandas(run, "path string, length long")
