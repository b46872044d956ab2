"""The baseline encoder against a plain decoder by the standard's definitions."""

import struct

import numpy as np
import pytest

from geostrata.sources import jpeg as J


def decoded(data):
    at, quant, huff = 2, {}, {}
    while True:
        mark, n = struct.unpack_from(">xBH", data, at)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            quant[body[0]] = np.array(list(body[1:65]))
        elif mark == 0xC0:
            h, w = struct.unpack_from(">HH", body, 1)
        elif mark == 0xC4:
            code, k, table = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    assert code != (1 << length) - 1, "a code of ones"
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            huff[body[0]] = table
        elif mark == 0xDA:
            break
    assert data[-2:] == b"\xff\xd9"
    bits = iter("".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\0", b"\xff")))

    def number(n):
        v = int("".join(next(bits) for _ in range(n)) or "0", 2)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(table):
        code, n = 0, 0
        while (n, code) not in table:
            code, n = code * 2 + int(next(bits)), n + 1
        return table[n, code]

    zigzag = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    basis = [[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]
    basis, last = np.array(basis), [0, 0, 0]
    out = np.zeros((-(-h // 8) * 8, -(-w // 8) * 8, 3))
    for r in range(0, out.shape[0], 8):
        for c in range(0, out.shape[1], 8):
            for k in range(3):
                t, values = min(k, 1), np.zeros((8, 8))
                last[k] += number(symbol(huff[t]))
                values[0, 0], i = last[k] * quant[t][0], 1
                while i < 64:
                    s = symbol(huff[16 + t])
                    if s == 0:
                        break
                    i += s >> 4
                    if s & 15:
                        values[zigzag[i]] = number(s & 15) * quant[t][i]
                    i += 1
                out[r : r + 8, c : c + 8, k] = basis.T @ values @ basis
    y, cb, cr = out[:h, :w, 0] + 128, out[:h, :w, 1], out[:h, :w, 2]
    assert len("".join(bits)) < 8
    return np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (17, 29), (40, 9)])
def test_smooth_images_come_back(shape):
    r, c = np.indices(shape)
    pixels = np.stack([r * 5 % 256, c * 7 % 256, (r + c) * 3 % 256], axis=-1).astype(np.uint8)
    assert np.abs(decoded(J.jpeg_bytes(pixels, 95)) - pixels).mean() < 3


def test_noise_needs_long_codes_and_runs():
    some = np.random.default_rng(1)
    noise = some.integers(0, 256, (64, 48, 3)).astype(np.uint8)
    assert np.abs(decoded(J.jpeg_bytes(noise, 100)) - noise).max() < 4
    high = np.full((32, 32, 3), 128, np.uint8)
    high[::2, ::2] += 100  # only the last places along the zigzag, after long runs
    assert np.abs(decoded(J.jpeg_bytes(high, 100)) - high).max() < 4
    assert len(J.jpeg_bytes(noise, 20)) < len(J.jpeg_bytes(noise, 90))


def test_code_lengths_are_bounded_and_whole():
    counts = np.zeros(256, int)
    counts[:40] = [min(2**k, 2**50) for k in range(40)]
    bits = J.lengths(counts)
    assert max(bits.values()) <= 16 and sum(2.0**-n for n in bits.values()) == 1 and set(bits) == {-1, *range(40)}
    code, width, text = J.codes(bits)
    words = sorted(f"{code[s]:0{width[s]}b}" for s in range(40))
    assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False)) and sum(text[:16]) == 40


def test_one_image_a_key(spark):
    cells = spark.createDataFrame([("a", 0, 0, 200, 10, 30), ("a", 8, 3, 0, 0, 0), ("b", 0, 0, 255, 255, 255), ("b", None, 1, 0, 0, 0)], "tile string, row int, col int, red int, green int, blue int")
    got = {r.tile: decoded(bytes(r.jpeg)).shape for r in J.photo_files(cells, "tile").collect()}
    assert got == {"a": (9, 4, 3), "b": (1, 1, 3)} and J.photo_files(cells.limit(0), "tile").count() == 0
    with pytest.raises(ValueError):
        J.jpeg_bytes(np.zeros((0, 3, 3), np.uint8))
