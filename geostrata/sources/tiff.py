"""TIFF rasters by block: directories, overviews and windows read as ranges of a file, never the file as a whole.

``read_raster`` lists the blocks of all files first and deals them out, so that one large image is the work of many tasks.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.sources.text import listing

#: Field types: bytes and struct code of each. Fixed values of the format.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d")}
#: numpy kind by bits and sample format. Fixed values of the format.
KINDS = {(8, 1): "u1", (16, 1): "u2", (16, 2): "i2", (32, 1): "u4", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}
#: Cells in one frame of output at most.
CELLS = 1 << 18


class Block(NamedTuple):
    """A strip or tile: where its cells belong, where its bytes lie, and how they are packed."""

    row: int
    col: int
    rows: int  # cells within the image
    cols: int
    stride: int  # cells of a stored line
    offset: int
    size: int
    kind: str
    samples: int
    packing: int
    predictor: int


BLOCKS = "path string, row long, col long, rows long, cols long, stride long, offset long, size long, kind string, samples int, packing int, predictor int"


class Image(NamedTuple):
    width: int
    height: int
    blocks: list[Block]


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit on, one bit wider one code early."""
    out, table = [], [bytes([i]) for i in range(256)] + [b"", b""]
    width, hold, bits, last = 9, 0, 0, None
    for byte in data:
        hold, bits = hold << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, hold = hold >> bits, hold & (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if code == 257:
            break
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last is not None:
            table.append(last + word[:1])
        last = word
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return b"".join(out)


UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress}


def _at(f: BinaryIO, offset: int, size: int) -> bytes:
    f.seek(offset)
    return f.read(size)


def directories(f: BinaryIO) -> list[Image]:
    """Every image of a file, the full one first as a rule and its overviews after it; only headers are read."""
    head = _at(f, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, seen, images = struct.unpack(order + "I", head[4:])[0], set(), []
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(order + "H", _at(f, at, 2))[0]
        entries, (following,) = _at(f, at + 2, 12 * n), struct.unpack(order + "I", _at(f, at + 2 + 12 * n, 4).rjust(4, b"\0"))
        tags: dict[int, tuple] = {}
        for i in range(0, 12 * n, 12):
            tag, kind, count = struct.unpack_from(order + "HHI", entries, i)
            if kind in TYPES:
                size, code = TYPES[kind]
                short = size * count <= 4
                raw = entries[i + 8 : i + 8 + size * count] if short else _at(f, struct.unpack_from(order + "I", entries, i + 8)[0], size * count)
                tags[tag] = struct.unpack(order + (f"{count}s" if code == "s" else code * count), raw)
        images.append(_image(tags, order))
        at = following
    return images


def _image(tags: dict[int, tuple], order: str) -> Image:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, tiled = one(256, 0), one(257, 0), 322 in tags
    high, wide = (one(323, height), one(322, width)) if tiled else (min(one(278, height), height), width)
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if one(284, 1) == 2 and one(277, 1) > 1:
        raise ValueError("samples in planes of their own aren't read")
    kind = order + KINDS[one(258, 8), one(339, 1)]
    across, blocks = -(-width // wide), []
    for i, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        row, col = i // across * high, i % across * wide
        blocks.append(Block(row, col, min(high, height - row), min(wide, width - col), wide, offset, size, kind, one(277, 1), one(259, 1), one(317, 1)))
    return Image(width, height, blocks)


def decode(raw: bytes, b: Block) -> np.ndarray:
    """Cells (rows, columns, samples) of a block within its image; a block that ends early, or has no bytes, is filled with zeros."""
    if b.predictor not in (1, 2):
        raise ValueError(f"predictor {b.predictor}")
    cells = np.frombuffer(UNPACK[b.packing](raw) if raw else b"", b.kind)
    lines = cells[: len(cells) // (b.stride * b.samples) * b.stride * b.samples].reshape(-1, b.stride, b.samples)
    if b.predictor == 2:
        lines = np.cumsum(lines, axis=1, dtype=lines.dtype.newbyteorder("="))
    out = np.zeros((b.rows, b.cols, b.samples), np.dtype(b.kind).newbyteorder("="))
    part = lines[: b.rows, : b.cols]
    out[: len(part)] = part
    return out


def meets(b: Block, row: int, col: int, rows: int, cols: int) -> bool:
    return b.row < row + rows and b.row + b.rows > row and b.col < col + cols and b.col + b.cols > col


def window(f: BinaryIO, image: Image, row: int, col: int, rows: int, cols: int) -> np.ndarray:
    """Part of an image, clipped to it; only blocks that meet the window are read."""
    row1, col1, row, col = min(row + rows, image.height), min(col + cols, image.width), max(row, 0), max(col, 0)
    first = image.blocks[0]
    out = np.zeros((max(row1 - row, 0), max(col1 - col, 0), first.samples), np.dtype(first.kind).newbyteorder("="))
    for b in image.blocks:
        if out.size and meets(b, row, col, *out.shape[:2]):
            top, left, bottom, right = max(b.row, row), max(b.col, col), min(b.row + b.rows, row1), min(b.col + b.cols, col1)
            cells = decode(_at(f, b.offset, b.size), b)
            out[top - row : bottom - row, left - col : right - col] = cells[top - b.row : bottom - b.row, left - b.col : right - b.col]
    return out[..., 0] if first.samples == 1 else out


def overview(images: list[Image], factor: float) -> int:
    """Place of the coarsest image that is at most ``factor`` times coarser than the full one."""
    fit = [i for i, m in enumerate(images) if images[0].width <= factor * m.width * (1 + 1e-9)]
    return min(fit, key=lambda i: images[i].width, default=0)


def tiff(data: bytes, level: int = 0) -> np.ndarray:
    """An image of a TIFF as (rows, columns[, samples]): strips or tiles; plain, LZW or deflate; predictor 1 or 2; either byte order."""
    f = io.BytesIO(data)
    image = directories(f)[level]
    return window(f, image, 0, 0, image.height, image.width)


def opened(path: str) -> BinaryIO:
    """A file for reads by range; the store must be one that pyarrow opens."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def blocks_of(spark: SparkSession, path: str, factor: float = 1.0, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Blocks of the coarsest image of each file that ``factor`` allows, and of a window (row, col, rows, cols) of that image if one is given."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["path"]:
                with opened(p) as f:
                    images = directories(f)
                blocks = [b for b in images[overview(images, factor)].blocks if box is None or meets(b, *box)]
                yield pd.DataFrame([(p, *b) for b in blocks], columns=["path", *Block._fields])

    return listing(spark, path).select("path").mapInPandas(run, BLOCKS)


def read_raster(
    spark: SparkSession, path: str, nodata: float | None = None, factor: float = 1.0, box: tuple[int, int, int, int] | None = None, band: int = 0
) -> DataFrame:
    """(path, row, col, value) of TIFF files; values at or below ``nodata`` and NaN are null.

    ``factor`` picks an overview and ``box`` (row, col, rows, cols) a window of it. Blocks, not files, are dealt out to tasks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, *fields in frame.itertuples(index=False):
                b = Block(*fields)
                with opened(p) as f:
                    cells = decode(_at(f, b.offset, b.size), b)[..., band]
                step = max(1, CELLS // max(b.cols, 1))
                for r in range(0, b.rows, step):
                    part = cells[r : r + step]
                    rows, cols = np.indices(part.shape)
                    yield pd.DataFrame({"path": p, "row": (rows + b.row + r).ravel(), "col": (cols + b.col).ravel(), "value": part.ravel().astype("float64")})

    dealt = blocks_of(spark, path, factor, box).repartition("path", "offset")
    out = dealt.mapInPandas(run, "path string, row long, col long, value double")
    if box is not None:
        row, col, rows, cols = box
        out = out.where((F.col("row") >= row) & (F.col("row") < row + rows) & (F.col("col") >= col) & (F.col("col") < col + cols))
    bad = F.isnan("value") if nodata is None else F.isnan("value") | (F.col("value") <= nodata)
    return out.withColumn("value", F.when(~bad, F.col("value")))
