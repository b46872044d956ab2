"""Baseline JPEG images of colour rasters, with Huffman tables fitted to each image."""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Quantisation of luminance and chrominance at quality 50, row by row. Fixed values of the standard's annex K.
LUMINANCE = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
CHROMINANCE = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""
#: Red, green and blue to luminance and the two colour differences. Fixed values of the file format.
COLOUR = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])

_U, _X = np.arange(8)[:, None], np.arange(8)[None]
DCT = np.where(_U == 0, np.sqrt(0.125), 0.5 * np.cos((2 * _X + 1) * _U * np.pi / 16))
#: Places of an 8 by 8 block along its diagonals, to and fro.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8)))
#: Bits of a code at most. Fixed value of the format.
LONGEST = 16


def quantisers(quality: int) -> list[np.ndarray]:
    """Both tables for a quality from 1 to 100."""
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t.split(), int) * percent + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE)]


def blocks(pixels: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Quantised coefficients (block, component, place along the zigzag); edge pixels are repeated up to whole blocks."""
    h, w, _ = pixels.shape
    p = np.pad(pixels, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(float) @ COLOUR.T
    p[..., 0] -= 128
    cut = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8, 3).transpose(0, 2, 4, 1, 3).reshape(-1, 3, 8, 8)
    steps = np.stack([tables[0], tables[1], tables[1]]).reshape(3, 8, 8)
    return np.rint(DCT @ cut @ DCT.T / steps).astype(np.int64).reshape(-1, 3, 64)[..., ZIGZAG]


def events(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is written, in order: table (two for luminance, then two for colour: first coefficients, others), symbol, bits that follow, and their count."""
    q = coefficients.copy()
    q[..., 0] = np.diff(q[..., 0], axis=0, prepend=0)
    q = q.reshape(-1, 64)
    block, place = np.nonzero(q[:, 1:])
    place += 1
    same = np.concatenate([[False], block[1:] == block[:-1]]) if len(block) else np.zeros(0, bool)
    run = place - np.where(same, np.concatenate([[0], place[:-1]]) if len(place) else place, 0) - 1
    last = np.zeros(len(q), int)
    last[block] = place  # ascending, so that the last one stays
    ends = np.flatnonzero(last < 63)
    skips = np.repeat(np.arange(len(block)), run // 16)
    value = np.concatenate([q[:, 0], q[block, place], np.zeros(len(skips) + len(ends), int)])
    size = np.frexp(np.abs(value).astype(float))[1]
    above = np.concatenate([np.zeros(len(q), int), run % 16, np.full(len(skips), 15), np.zeros(len(ends), int)])
    owner = np.concatenate([np.arange(len(q)), block, block[skips], ends])
    turn = np.concatenate([np.zeros(len(q), int), 2 * place + 1, 2 * place[skips], np.full(len(ends), 255)])
    table = np.where(owner % 3 == 0, 0, 2) + (turn > 0)
    order = np.argsort(owner * 256 + turn, kind="stable")
    extra = np.where(value < 0, value + (1 << size) - 1, value)
    return table[order], (above * 16 + size)[order], extra[order], size[order]


def lengths(counts: np.ndarray) -> dict[int, int]:
    """Bits of each symbol that occurs, at most 16, by merging packages; a further symbol takes the code of ones that the format forbids."""
    leaves = sorted([(int(n), (s,)) for s, n in enumerate(counts) if n] + [(0, (-1,))])
    level: list = []
    for _ in range(LONGEST):
        level = list(heapq.merge(leaves, [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2])]))  # noqa: B905
    bits: dict[int, int] = {}
    for _, symbols in level[: 2 * (len(leaves) - 1)]:
        for s in symbols:
            bits[s] = bits.get(s, 0) + 1
    return bits


def codes(bits: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and bits by symbol, and the table as files state it."""
    ranked = sorted((n, s < 0, s) for s, n in bits.items())
    code, width, at, before = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, ranked[0][0]
    for n, dummy, s in ranked:
        at, before = at << (n - before), n
        if not dummy:
            code[s], width[s] = at, n
        at += 1
    kept = [(n, s) for n, dummy, s in ranked if not dummy]
    return code, width, bytes(sum(n == k for n, _ in kept) for k in range(1, LONGEST + 1)) + bytes(s for _, s in kept)


def jpeg_bytes(pixels: np.ndarray, quality: int = 85) -> bytes:
    """A baseline JPEG of (rows, columns, red green blue) bytes, colours at full resolution."""
    if pixels.ndim != 3 or pixels.shape[2] != 3 or not 0 < min(pixels.shape[:2]) or max(pixels.shape[:2]) > 65535:
        raise ValueError("rows and columns from 1 to 65535 of three colours")
    tables = quantisers(quality)
    table, symbol, extra, size = events(blocks(pixels, tables))
    word, width, stated = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64), []
    for t in range(4):
        mine = table == t
        code, bits, text = codes(lengths(np.bincount(symbol[mine], minlength=256)))
        word[mine], width[mine] = code[symbol[mine]], bits[symbol[mine]]
        stated.append(bytes([t % 2 * 16 + t // 2]) + text)
    word, width = word << size | extra, width + size
    which = np.repeat(np.arange(len(word)), width)
    shift = np.repeat(np.cumsum(width), width) - 1 - np.arange(len(which))
    stream = np.concatenate([(word[which] >> shift & 1).astype(np.uint8), np.ones(-len(which) % 8, np.uint8)])

    def segment(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 255, mark, len(body) + 2) + body

    h, w, _ = pixels.shape
    parts = [segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")] + [segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(tables)]
    parts += [segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes(v for k in range(3) for v in (k + 1, 0x11, min(k, 1))))]
    parts += [segment(0xC4, s) for s in stated] + [segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))]
    return b"\xff\xd8" + b"".join(parts) + np.packbits(stream).tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def photo_files(cells: DataFrame, key: str, quality: int = 85) -> DataFrame:
    """(key, jpeg) of colour rasters (key, row, col, red, green, blue), one image for each key; missing cells are black.

    An image is built in one task, so a key should be a tile or a page of bounded size.
    """
    colours = ["red", "green", "blue"]

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        pixels = np.zeros((frame["row"].max() + 1, frame["col"].max() + 1, 3), np.uint8)
        pixels[frame["row"], frame["col"]] = frame[colours]
        return pd.DataFrame({key: frame[key].iloc[:1], "jpeg": [jpeg_bytes(pixels, quality)]})

    kind = cells.schema[key].dataType.simpleString()
    return cells.select(key, "row", "col", *colours).dropna().groupBy(key).applyInPandas(draw, f"{key} {kind}, jpeg binary")
