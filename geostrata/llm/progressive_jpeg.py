"""Progressive JPEG media columns.

The decoder reads any number of progressive, Huffman-coded JPEG files at once: it
accumulates spectral-selection and successive-approximation scans into coefficient
arrays, inverse-transforms them in numpy, upsamples chroma and yields full-resolution
RGB tensors. Entropy decoding goes in lockstep over all restart intervals of all files
of a batch, so that numpy handles one symbol of thousands of intervals at a time.

The encoder stores a payload losslessly in the unit of the format, the quantised
coefficient: byte b becomes b - 128 if that is negative, else b - 127, in zigzag order
(never 0, so a stored zero is padding). Samples can't carry it, as the transform rounds.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import chunks, ranges, table, text_bytes

#: Payload bytes in the 6 blocks of a 4:2:0 minimum coded unit, and the unit that payloads are padded to.
MCU_BYTES, PAD = 384, 192
#: Minimum coded units to a row of the stored image, and most rows (16 lines each).
ROW, ROWS = 8, 4095
#: Units between restart markers: one lane of the decoder.
RESTART = 8
#: Bytes of text handled at once.
BATCH = 2 << 20

#: (components, first and last coefficient, high and low bit) of each stored scan.
SCANS = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0))


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag()


def canonical(symbols: list[tuple[int, int]]) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Of (symbol, code length): counts by length, symbols, and code and length by symbol."""
    order = sorted(symbols, key=lambda s: (s[1], s[0]))
    counts, codes, lengths = [0] * 16, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    code = last = 0
    for symbol, n in order:
        code <<= n - last
        codes[symbol], lengths[symbol] = code, n
        counts[n - 1] += 1
        code, last = code + 1, n
    assert code < 1 << last, "the code of ones alone is reserved"
    return bytes(counts), bytes(s for s, _ in order), codes, lengths


#: DC differences have up to 11 bits. Runs of 0 with a size are the usual AC symbols.
DC_CODE = canonical([(s, 4) for s in range(12)])
AC_CODE = canonical([(s, 4) for s in range(11)] + [(s, 11) for s in range(11, 256) if s & 15 <= 10])


def table_of(counts: bytes, symbols: bytes) -> np.ndarray:
    """Length << 8 | symbol for each 16 bits that a code can start; 0 where none does."""
    look, code, i = np.zeros(65536, np.int64), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[i]
            code, i = code + 1, i + 1
        code <<= 1
    return look


def shape_of(n: int) -> tuple[int, int]:
    """MCUs across and down for a payload of n bytes."""
    units = max(1, -(-n // MCU_BYTES))
    across = max(min(units, ROW), -(-units // ROWS))
    return across, -(-units // across)


#: Bits of each magnitude.
SIZE = np.array([n.bit_length() for n in range(1 << 11)], np.int64)


def pack(values: np.ndarray, lengths: np.ndarray, lane: np.ndarray, n: int) -> list[bytes]:
    """Bit strings of the n restart intervals, padded with ones to whole bytes and with a 0 after each byte 255.

    values, lengths: codes of each block in order of writing, a row for each block; lane: interval of each row, ascending.
    """
    values, lengths = values.astype(np.uint64, copy=False), lengths.astype(np.uint8)
    while values.shape[1] > 1:  # neighbours become one code as long as they fit
        if values.shape[1] % 2:
            values, lengths = np.pad(values, ((0, 0), (0, 1))), np.pad(lengths, ((0, 0), (0, 1)))
        both = lengths[:, ::2] + lengths[:, 1::2]
        if both.max(initial=0) > 56:
            break
        values, lengths = values[:, ::2] << lengths[:, 1::2] | values[:, 1::2], both
    width = values.shape[1]
    bits = np.bincount(lane, lengths.sum(axis=1), n).astype(np.int64)
    nbytes = (bits + 7) >> 3
    start = np.cumsum(nbytes) - nbytes
    values, lengths = values.ravel(), lengths.ravel().astype(np.int64)
    at = np.cumsum(lengths) - lengths + np.repeat((start * 8 - (np.cumsum(bits) - bits))[lane], width)
    used = lengths > 0
    if not used.all():
        values, lengths, at = values[used], lengths[used], at[used]
    total = int(nbytes.sum())
    words = np.zeros(total // 8 + 2, np.uint64)
    for v, size, place in ((values, lengths, at), ((np.uint64(1) << (nbytes * 8 - bits).astype(np.uint64)) - np.uint64(1), nbytes * 8 - bits, start * 8 + bits)):
        v, size, place = v[size > 0], size[size > 0], place[size > 0]
        if not len(v):
            continue
        where, off = place >> 6, place & 63
        top = v << (64 - size).astype(np.uint64)
        for part, w in ((top >> off.astype(np.uint64), where), (np.where(off > 0, top << (64 - np.maximum(off, 1)).astype(np.uint64), np.uint64(0)), where + 1)):
            new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            words[w[new]] |= np.bitwise_or.reduceat(part, new)
    data = words.astype(">u8").view(np.uint8)[:total]
    ends = np.cumsum(nbytes)
    if (full := np.flatnonzero(data == 255)).size:
        data = np.insert(data, full + 1, 0)
        ends = ends + np.searchsorted(full, ends)
    out, raw, last = [], data.tobytes(), 0
    for e in ends.tolist():
        out.append(raw[last:e])
        last = e
    return out


def markers(across: int, down: int, payload: int) -> bytes:
    """Everything before the first scan. A comment holds the payload's bytes."""
    out = [b"\xff\xd8", b"\xff\xfe" + struct.pack(">H8s", 10, payload.to_bytes(8, "big")), b"\xff\xdb\x00\x43\x00" + b"\x01" * 64]
    out.append(b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, down * 16, across * 16, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    for kind, (counts, symbols, _, _) in ((0x00, DC_CODE), (0x10, AC_CODE)):
        out.append(b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), kind) + counts + symbols)
    out.append(b"\xff\xdd" + struct.pack(">HH", 4, RESTART))
    return b"".join(out)


@lru_cache(maxsize=256)
def component_blocks(across: int, down: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each component, the payload's block (of 6 to an MCU) at each block in raster order."""
    unit = np.arange(across * down).reshape(down, across)
    luma = np.empty((down * 2, across * 2), np.int64)
    for r in range(2):
        for c in range(2):
            luma[r::2, c::2] = unit * 6 + r * 2 + c
    return luma.ravel(), (unit * 6 + 4).ravel(), (unit * 6 + 5).ravel()


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file of each payload; all of one batch are coded together."""
    shapes = [shape_of(len(p)) for p in payloads]
    units = np.array([a * d for a, d in shapes], np.int64)
    base = (np.cumsum(units) - units) * 6
    coefs = np.zeros((int(units.sum()) * 6, 64), np.int16)
    flat = coefs.ravel()
    for p, b in zip(payloads, base.tolist(), strict=True):
        v = np.frombuffer(p, np.uint8).astype(np.int16) - 128
        flat[b * 64 : b * 64 + len(v)] = v + (v >= 0)
    layout = [component_blocks(a, d) for a, d in shapes]
    parts: list[list[bytes]] = [[markers(a, d, len(p))] for p, (a, d) in zip(payloads, shapes, strict=True)]
    for comps, lo, hi, high, low in SCANS:
        if lo == 0:
            order, unit_of = [], []
            for (a, d), b in zip(shapes, base.tolist(), strict=True):
                order.append(np.arange(a * d * 6) + b)
            blocks = np.concatenate(order)
            per = units * 6
            step = 6 * RESTART
        else:
            order = [lay[comps[0]] + b for lay, b in zip(layout, base.tolist(), strict=True)]
            blocks = np.concatenate(order)
            per = np.array([len(o) for o in order], np.int64)
            step = RESTART
        lanes = -(-per // step)
        lane_first = np.cumsum(lanes) - lanes
        within = ranges(np.zeros(len(per), np.int64), per)
        lane = np.repeat(lane_first, per) + within // step
        if lo == 0:
            strings = _encode_dc(coefs, blocks, within, lane, int(lanes.sum()), high, low)
        elif not high:
            strings = _encode_first(coefs[blocks, lo : hi + 1], lane, int(lanes.sum()), low)
        else:
            strings = _encode_refine(coefs[blocks, lo : hi + 1], lane, int(lanes.sum()), low)
        head = b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(comps), len(comps)) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([lo, hi, high << 4 | low])
        for out, f, n in zip(parts, lane_first.tolist(), lanes.tolist(), strict=True):
            out.append(head)
            out.append(strings[f])
            for i in range(1, n):
                out.append(b"\xff" + bytes([0xD0 + (i - 1) % 8]))
                out.append(strings[f + i])
    return [b"".join(out) + b"\xff\xd9" for out in parts]


def _encode_dc(coefs: np.ndarray, blocks: np.ndarray, within: np.ndarray, lane: np.ndarray, n: int, high: int, low: int) -> list[bytes]:
    dc = coefs[blocks, 0].astype(np.int64)
    if high:
        return pack((dc >> low & 1)[:, None], np.ones((len(dc), 1)), lane, n)
    dc >>= low
    unit = within % (6 * RESTART)
    place = unit % 6
    # the block before of the same component in the interval
    back = np.where(place == 0, 3, np.where(place < 4, 1, 6))
    has = (unit >= 6) | ((place > 0) & (place < 4))
    index = np.arange(len(dc)) - back
    diff = dc - np.where(has, dc[np.maximum(index, 0)], 0)
    size = SIZE[np.abs(diff)]
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    code, length = DC_CODE[2][size], DC_CODE[3][size]
    return pack((code << size.astype(np.uint64) | bits)[:, None], (length + size)[:, None], lane, n)


def _encode_first(coefs: np.ndarray, lane: np.ndarray, n: int, low: int) -> list[bytes]:
    """Columns: for each coefficient up to three runs of 16 zeros, which are rare and so kept apart, and its symbol; then the end of block."""
    width = coefs.shape[1]
    value = np.abs(coefs) >> low
    code, length = AC_CODE[2], AC_CODE[3]
    size = SIZE[value]
    bits = np.where(coefs < 0, (1 << size) - 1 - value, value)
    there = value > 0
    place = np.arange(width)
    before = np.maximum.accumulate(np.where(there, place, -1), axis=1)
    run = np.empty_like(before)
    run[:, 0], run[:, 1:] = 0, place[1:] - before[:, :-1] - 1
    symbol = (run & 15) << 4 | size
    values, lengths = np.zeros((len(coefs), width + 1), np.uint64), np.zeros((len(coefs), width + 1), np.uint8)
    values[:, :width] = np.where(there, code[symbol] << size.astype(np.uint64) | bits.astype(np.uint64), 0)
    lengths[:, :width] = np.where(there, length[symbol] + size, 0)
    short = before[:, -1] < width - 1
    values[short, width], lengths[short, width] = code[0], length[0]
    skips = np.where(there, run >> 4, 0)
    if not skips.any():
        return pack(values, lengths, lane, n)
    wide, long = np.zeros((len(coefs), width + 1, 4), np.uint64), np.zeros((len(coefs), width + 1, 4), np.uint8)
    wide[..., 3], long[..., 3] = values, lengths
    for i in range(3):
        wide[:, :width, i], long[:, :width, i] = np.where(skips > i, code[0xF0], 0), np.where(skips > i, length[0xF0], 0)
    return pack(wide.reshape(len(coefs), -1), long.reshape(len(coefs), -1), lane, n)


def _encode_refine(coefs: np.ndarray, lane: np.ndarray, n: int, low: int) -> list[bytes]:
    """Every coefficient of a block is non-zero, or all are zero: no run of zeros precedes a new one.

    A correction bit is written after the next new coefficient's symbol, or after the end of block.
    """
    width = coefs.shape[1]
    mag = np.abs(coefs) >> low
    full = mag[:, 0] > 0
    if not (mag > 0)[full].all() or mag[~full].any():
        raise ValueError("a block mixes zeros with values")
    code, length = AC_CODE[2], AC_CODE[3]
    new, old = mag == 1, mag > 1
    values, lengths = np.empty((len(coefs), width + 1), np.uint64), np.zeros((len(coefs), width + 1), np.uint8)
    values[:, 1:], lengths[:, 1:] = mag & 1, old
    values[:, 0], lengths[:, 0] = code[0], length[0]
    if (rows := np.flatnonzero(new.any(axis=1))).size:
        fresh = new[rows]
        v, size = np.zeros((len(rows), width + 1), np.uint64), np.zeros((len(rows), width + 1), np.int64)
        v[:, :width] = np.where(fresh, code[1] << np.uint64(1) | (coefs[rows] > 0), mag[rows] & 1)
        size[:, :width] = np.where(fresh, length[1] + 1, old[rows])
        ends = ~fresh[:, -1]  # else the last coefficient is new, and no end follows
        v[:, width], size[:, width] = code[0], np.where(ends, length[0], 0)
        # each goes before the corrections that wait for it
        place = np.arange(width)
        upto = np.minimum.accumulate(np.where(fresh, place, width)[:, ::-1], axis=1)[:, ::-1]
        key = np.concatenate([np.where(fresh, place * 128, upto * 128 + 1 + place), np.full((len(rows), 1), width * 128)], axis=1)
        order = np.argsort(key, axis=1, kind="stable")
        values[rows], lengths[rows] = np.take_along_axis(v, order, axis=1), np.take_along_axis(size, order, axis=1)
    return pack(values, lengths, lane, n)


#: A marker that ends a scan's data: neither a stuffed zero nor a restart.
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class Scan:
    """One scan of one file: its parameters, tables and entropy-coded bytes."""

    __slots__ = ("ac", "comps", "data", "dc", "high", "hi", "lo", "low", "restart")


class Image:
    """Frame of one file: size, components as (id, across, down, table), quantisation and scans."""

    def __init__(self, raw: bytes):
        self.comment, self.scans, quant, huff, restart, at = b"", [], {}, {}, 0, 2
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            if raw[at] != 255:
                raise ValueError("a marker is missing")
            kind = raw[at + 1]
            if kind == 0xD9:
                break
            n = int.from_bytes(raw[at + 2 : at + 4], "big")
            body = raw[at + 4 : at + 2 + n]
            at += 2 + n
            if kind == 0xFE:
                self.comment = body
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    count = sum(body[1:17])
                    huff[body[0]] = (body[1:17], body[17 : 17 + count])
                    body = body[17 + count :]
            elif kind == 0xDD:
                restart = int.from_bytes(body[:2], "big")
            elif kind == 0xC2:
                bits, self.height, self.width, count = struct.unpack(">BHHB", body[:6])
                if bits != 8:
                    raise ValueError("samples of 8 bits only")
                self.comps = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count))
            elif 0xC0 <= kind <= 0xCF and kind != 0xC8:
                raise ValueError("not a progressive Huffman file")
            elif kind == 0xDA:
                s = Scan()
                ids = [c[0] for c in self.comps]
                s.comps = tuple(ids.index(body[1 + 2 * i]) for i in range(body[0]))
                picks = [body[2 + 2 * i] for i in range(body[0])]
                s.lo, s.hi, s.high, s.low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
                s.restart = restart
                s.dc = tuple(huff.get(p >> 4) for p in picks)
                s.ac = huff.get(0x10 | picks[0] & 15)
                after = MARKER.search(raw, at)
                if after is None:
                    raise ValueError("the end of the file is missing")
                s.data = raw[at : after.start()]
                at = after.start()
                self.scans.append(s)
        self.quant = [quant[c[3]] for c in self.comps]
        self.h, self.v = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))

    def blocks(self, c: int) -> int:
        return self.across * self.down * self.comps[c][1] * self.comps[c][2]


def decode(files: list[bytes]) -> list[tuple[Image, list[np.ndarray]]]:
    """Of each file its frame and, by component, coefficients in zigzag order: (blocks down, blocks across, 64)."""
    images = [Image(f) for f in files]
    first, total = [], 0
    for im in images:
        own = []
        for c in range(len(im.comps)):
            own.append(total)
            total += im.blocks(c)
        first.append(own)
    coefs = np.zeros(total * 64, np.int16)
    # scans of one kind at one turn are decoded together; a file's own scans stay in order
    for turn in range(max((len(im.scans) for im in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, im in enumerate(images):
            if turn < len(im.scans):
                s = im.scans[turn]
                groups.setdefault((s.lo, s.hi, s.high, s.low, s.dc if not s.lo and not s.high else None, s.ac if s.lo else None), []).append(i)
        for (lo, hi, high, low, dc, ac), members in groups.items():
            _scan(images, first, coefs, members, turn, lo, hi, high, low, dc, ac)
    out = []
    for im, own in zip(images, first, strict=True):
        out.append((im, [coefs[f * 64 : (f + im.blocks(c)) * 64].reshape(im.down * im.comps[c][2], im.across * im.comps[c][1], 64) for c, f in enumerate(own)]))
    return out


@lru_cache(maxsize=512)
def _order(width: int, height: int, comps: tuple, picked: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in coded order, as numbers in the file; the scan component of each; blocks to a coded unit."""
    most_h, most_v = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    first = np.cumsum([0] + [across * down * c[1] * c[2] for c in comps])
    if len(picked) == 1:
        _, h, v, _ = comps[picked[0]]
        wide, high = -(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)
        grid = np.arange(across * h * down * v).reshape(down * v, across * h)[:high, :wide]
        return grid.ravel() + first[picked[0]], np.zeros(grid.size, np.int64), 1
    parts, which = [], []
    for i, c in enumerate(picked):
        _, h, v, _ = comps[c]
        parts.append((np.arange(across * h * down * v) + first[c]).reshape(down, v, across, h).transpose(0, 2, 1, 3).reshape(across * down, h * v))
        which += [i] * (h * v)
    units = np.concatenate(parts, axis=1)
    return units.ravel(), np.tile(np.array(which), len(units)), units.shape[1]


def _scan(images: list[Image], first: list[list[int]], coefs: np.ndarray, members: list[int], turn: int, lo: int, hi: int, high: int, low: int, dc, ac) -> None:
    raw, blocks, which, counts, need = [], [], [], [], []
    for i in members:
        s = images[i].scans[turn]
        im = images[i]
        order, comp, per = _order(im.width, im.height, im.comps, s.comps)
        order = order + first[i][0]
        step = s.restart * per or len(order)
        n = -(-len(order) // step)
        raw.append(s.data)
        need.append(n)
        blocks.append(order)
        which.append(comp)
        own = np.full(n, step, np.int64)
        own[-1] = len(order) - step * (n - 1)
        counts.append(own)
    counts = np.concatenate(counts)
    blocks, which = np.concatenate(blocks), np.concatenate(which)
    # restart markers part the lanes, and so do the files: a marker is put between them; then drop the stuffed zeros
    data = np.frombuffer(b"\xff\xd0".join(raw), np.uint8)
    ff = np.flatnonzero(data[:-1] == 255) if len(data) else np.empty(0, np.int64)
    nxt = data[ff + 1]
    marks = ff[(nxt >= 0xD0) & (nxt <= 0xD7)]
    if len(marks) + 1 != len(counts):
        raise ValueError("restart intervals are missing")
    keep = np.ones(len(data), bool)
    keep[ff[nxt == 0] + 1] = False
    keep[marks] = False
    keep[marks + 1] = False
    kept = np.cumsum(keep)
    starts = np.concatenate([[0], kept[marks]]).astype(np.int64)
    data = np.concatenate([data[keep], np.zeros(8, np.uint8)])
    n = len(data) - 7
    win = np.zeros(n, np.uint64)
    for i in range(8):
        win |= data[i : n + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    at = np.cumsum(counts) - counts
    pos = starts * 8
    if lo == 0 and high:
        places = ranges(pos, counts)
        bit = (win[places >> 3] >> (np.uint64(63) - (places & 7).astype(np.uint64))).astype(np.int16) & 1
        coefs[blocks * 64] |= bit << low
    elif lo == 0:
        _decode_dc(win, pos, at, counts, blocks, which, coefs, low, [table_of(*t) for t in dc])
    elif not high:
        _decode_first(win, pos, at, counts, blocks, coefs, lo, hi, low, table_of(*ac))
    else:
        _decode_refine(win, pos, at, counts, blocks, coefs, lo, hi, low, table_of(*ac))


def _take(win: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """57 or more bits from pos on, at the top."""
    return win[pos >> 3] << (pos & 7).astype(np.uint64)


_TOP = np.uint64(48)


def _extra(w: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits after the first skip ones."""
    return ((w << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _decode_dc(win, pos, at, counts, blocks, which, coefs, low, looks) -> None:
    look = np.stack(looks)
    before = np.zeros((len(counts), len(looks)), np.int64)
    pos, live = pos.copy(), np.arange(len(counts))
    for i in range(int(counts.max(initial=0))):
        live = live[counts[live] > i]
        b = at[live] + i
        c = which[b]
        w = _take(win, pos[live])
        found = look[c, (w >> _TOP).astype(np.int64)]
        size, length = found & 255, found >> 8
        extra = _extra(w, length, size)
        diff = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        before[live, c] += diff
        coefs[blocks[b] * 64] = before[live, c] << low
        pos[live] += length + size


def _decode_first(win, pos, at, counts, blocks, coefs, lo, hi, low, look) -> None:
    block, end, pos, places = at.copy(), at + counts, pos.copy(), blocks * 64
    k = np.full(len(counts), lo, np.int64)
    lanes = np.arange(len(counts))  # block, end, pos and k hold the live lanes only
    while len(lanes):
        w = _take(win, pos)
        found = look[(w >> _TOP).astype(np.int64)]
        if not found.all():
            raise ValueError("a code that no table has")
        length, run, size = found >> 8, found >> 4 & 15, found & 15
        value = size > 0
        eob = ~value & (run < 15)
        bits = np.where(value, size, np.where(eob, run, 0))
        extra = _extra(w, length, bits)
        pos += length + bits
        k += run
        mag = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra) << low
        if value.all():
            coefs[places[block] + k] = mag
        else:
            v = np.flatnonzero(value)
            coefs[places[block[v]] + k[v]] = mag[v]
        k += 1
        done = eob | (k > hi)
        if done.any():
            d = np.flatnonzero(done)
            k[d] = lo
            block[d] += np.where(eob[d], (1 << run[d]) + extra[d], 1)
            stay = block < end
            if not stay.all():
                block, end, pos, k, lanes = block[stay], end[stay], pos[stay], k[stay], lanes[stay]


def _decode_refine(win, pos, at, counts, blocks, coefs, lo, hi, low, look) -> None:
    """A symbol names the zeros to pass before a new coefficient; every non-zero coefficient on the way has a correction bit.

    Where the walk stops follows from ranks among a block's zeros; the bits are read after the loop, all at once.
    """
    width = hi - lo + 1
    band = coefs.reshape(-1, 64)[blocks, lo : hi + 1]
    old = band != 0
    row, col = np.nonzero(~old)
    zeros = np.bincount(row, minlength=len(blocks)).astype(np.int64)
    zero_first = np.cumsum(zeros) - zeros
    old_first = np.arange(len(blocks) + 1) * width - np.concatenate([zero_first, [len(row)]])  # non-zero ones before each block
    block, end, pos = at.copy(), at + counts, pos.copy()
    z = np.zeros(len(block), np.int64)  # zeros of the block that are passed
    k = np.zeros(len(block), np.int64)
    fixes, news = [], []  # (bit, rank among the non-zero ones, count), (block, place, positive)
    padded = np.concatenate([col, [0]])
    while len(block):
        w = _take(win, pos)
        found = look[(w >> _TOP).astype(np.int64)]
        if not found.all():
            raise ValueError("a code that no table has")
        length, run, size = found >> 8, found >> 4 & 15, found & 15
        eob = (size == 0) & (run < 15)
        bits = np.where(eob, run, size & 1)
        extra = _extra(w, length, bits)
        pos += length + bits
        # where the walk stops: after run zeros, on the next; at the end of the block if there is none
        target = z + run
        has = ~eob & (target < zeros[block])
        stop = np.where(has, padded[np.minimum(zero_first[block] + target, len(row))], width)
        passed = np.where(has, target, zeros[block])
        skipped = np.where(eob, (1 << run) + extra, 1)  # an end-of-band run covers this block and the next ones
        blocks_on = np.where(eob, block + skipped, block)
        start_rank = old_first[block] + k - z
        stop_rank = np.where(eob, old_first[np.minimum(blocks_on, len(blocks))], old_first[block] + stop - passed)
        count = stop_rank - start_rank
        fixes.append((pos.copy(), start_rank, count))
        pos += count
        if (new := np.flatnonzero(has & (size > 0))).size:
            news.append((block[new], stop[new], extra[new]))
        k = stop + 1
        z = np.where(has, target + 1, zeros[block])
        over = eob | (k >= width)
        block = np.where(eob, blocks_on, np.where(over, block + 1, block))
        k[over] = 0
        z[over] = 0
        stay = block < end
        if not stay.all():
            block, end, pos, k, z = block[stay], end[stay], pos[stay], k[stay], z[stay]
    step = np.int16(1 << low)
    if fixes:
        p, r, c = (np.concatenate(x) for x in zip(*fixes, strict=True))
        places, rank = ranges(p, c), ranges(r, c)
        bit = (win[places >> 3] >> (np.uint64(63) - (places & 7).astype(np.uint64))).astype(np.int16) & 1
        values = band[old]
        values[rank] += np.sign(values[rank]) * bit * step
        band[old] = values
    for b, s, positive in news:
        band[b, s] = np.where(positive > 0, step, -step)
    coefs.reshape(-1, 64)[blocks, lo : hi + 1] = band


def cosines() -> np.ndarray:
    """Weight of frequency u at sample x, as [u][x]."""
    x, u = np.arange(8), np.arange(8)[:, None]
    return (np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)).astype(np.float32)


COSINES = cosines()


def _axis(planes: np.ndarray) -> np.ndarray:
    """Inverse transform along the first axis, in a fixed order of additions: equal blocks give equal samples in any batch."""
    out = np.empty_like(planes)
    even = [planes[u] for u in (0, 2, 4, 6)]
    odd = [planes[u] for u in (1, 3, 5, 7)]
    for x in range(4):
        a = even[0] * COSINES[0, x]
        for i in (1, 2, 3):
            a += even[i] * COSINES[2 * i, x]
        b = odd[0] * COSINES[1, x]
        for i in (1, 2, 3):
            b += odd[i] * COSINES[2 * i + 1, x]
        np.add(a, b, out=out[x])
        np.subtract(a, b, out=out[7 - x])
    return out


def samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples 0 to 255 of blocks of zigzag coefficients, as (block, y, x)."""
    natural = np.empty((64, len(coefs)), np.float32)
    natural[ZIGZAG] = (coefs * quant.astype(np.int32)).T
    rows = _axis(natural.reshape(8, 8, -1))  # [y][u][block]
    both = _axis(np.ascontiguousarray(rows.transpose(1, 0, 2)))  # [x][y][block]
    both += np.float32(128)
    np.rint(both, out=both)
    return np.clip(both, 0, 255, out=both).astype(np.uint8).transpose(2, 1, 0)


#: Coded units that are transformed at once.
UNITS = 1024
#: Cb and Cr weights of R, G and B.
CHROMA = ((0, 1.402), (-0.344136, -0.714136), (1.772, 0))


def tensors(decoded: list[tuple[Image, list[np.ndarray]]]) -> list[np.ndarray]:
    """(height, width, 3) RGB of each file, grey repeated; chroma is repeated to full resolution. Files of one layout are done together."""
    groups: dict[tuple, list[int]] = {}
    for i, (im, _) in enumerate(decoded):
        groups.setdefault((tuple(c[1:3] for c in im.comps), *(q.tobytes() for q in im.quant)), []).append(i)
    out: list[np.ndarray] = [np.empty(0)] * len(decoded)
    for members in groups.values():
        im = decoded[members[0]][0]
        units = []
        for c, (_, h, v, _) in enumerate(im.comps):
            own = []
            for i in members:
                g, coefs = decoded[i]
                own.append(coefs[c].reshape(g.down, v, g.across, h, 64).transpose(0, 2, 1, 3, 4).reshape(-1, v * h, 64))
            units.append(np.concatenate(own))
        rgb = np.empty((len(units[0]), im.v * 8, im.h * 8, 3), np.uint8)
        for a in range(0, len(rgb), UNITS):
            planes = []
            for (_, h, v, _), u, q in zip(im.comps, units, im.quant, strict=True):
                u = u[a : a + UNITS]
                p = samples(u.reshape(-1, 64), q).reshape(len(u), v, h, 8, 8).transpose(0, 1, 3, 2, 4).reshape(len(u), v * 8, h * 8)
                p = np.repeat(p, im.v // v, axis=1) if v != im.v else p
                planes.append((np.repeat(p, im.h // h, axis=2) if h != im.h else p).astype(np.float32))
            part = rgb[a : a + UNITS]
            if len(planes) == 1:
                part[...] = planes[0][..., None]
                continue
            y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
            for i, (b, r) in enumerate(CHROMA):
                x = y + np.float32(b) * cb if b else y.copy()
                if r:
                    x += np.float32(r) * cr
                np.rint(x, out=x)
                part[..., i] = np.clip(x, 0, 255, out=x)
        at = 0
        for i in members:
            g = decoded[i][0]
            n = g.across * g.down
            whole = rgb[at : at + n].reshape(g.down, g.across, im.v * 8, im.h * 8, 3).transpose(0, 2, 1, 3, 4).reshape(g.down * im.v * 8, g.across * im.h * 8, 3)
            out[i] = np.ascontiguousarray(whole[: g.height, : g.width])
            at += n
    return out


def payload_of(im: Image, coefs: list[np.ndarray]) -> bytes:
    """The payload that ``encode`` stored in these coefficients."""
    n = int.from_bytes(im.comment, "big")
    blocks = np.empty((im.across * im.down * 6, 64), np.int16)
    for order, c in zip(component_blocks(im.across, im.down), coefs, strict=True):
        blocks[order] = c.reshape(-1, 64)
    v = blocks.ravel()[:n]
    if not v.all():
        raise ValueError("the payload is damaged")
    return (v + 128 - (v > 0)).astype(np.uint8).tobytes()


def padded(text: bytes) -> bytes:
    return text.ljust(max(PAD, -(-len(text) // PAD) * PAD), b" ")


def encode_media(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8 bytes, padded with blanks to a positive multiple of 192, as a progressive JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", BATCH):
            texts = text_bytes(batch.column(1))
            media = encode([padded(t) for t in texts])
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def decode_media(media: DataFrame, keep: bool = True) -> DataFrame:
    """Adds to doc_id, n_bytes, media what decoding the stored files gives: payload, height, width, feature and, if asked for, the RGB tensor (row-major uint8).

    feature: size, channel means and CRC of the tensor. Equal files give equal values in any batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media", BATCH):
            files = batch.column(2).to_pylist()
            rows = []
            decoded = decode(files)
            for (im, coefs), pixels in zip(decoded, tensors(decoded), strict=True):
                raw = pixels.tobytes()
                mean = np.add.reduce(pixels.reshape(-1, 3), axis=0, dtype=np.int64) / (im.height * im.width)
                feature = f"{im.height}x{im.width}x3 mean {mean[0]:.3f} {mean[1]:.3f} {mean[2]:.3f} crc {zlib.crc32(raw):08x}"
                rows.append((payload_of(im, coefs), im.height, im.width, feature, raw if keep else None))
            payload, height, width, feature, rgb = zip(*rows, strict=True)
            made = [pa.array(payload, pa.binary()), pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.array(feature, pa.string())]
            yield pa.record_batch([*batch.columns, *made, *([pa.array(rgb, pa.binary())] if keep else [])], names=[*batch.schema.names, "payload", "height", "width", "feature", *(["rgb"] if keep else [])])

    kind = media.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, media binary, payload binary, height int, width int, feature string" + ", rgb binary" * keep
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, out)


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored files, what is read back from them, and their pictures as tensors: height x width x 3 uint8, row by row.

    Null and empty texts are a payload of 192 blanks.
    """
    back = decode_media(encode_media(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(1, length(payload) - 15), 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        F.col("rgb").alias("tensor"),
    )
