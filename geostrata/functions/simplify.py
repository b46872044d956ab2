"""Line simplification by greatest deviation from the chord, as an Arrow-batched function of coordinate arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf


def kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[int]:
    """Places of the vertices that stay: the ends, and wherever a part strays from its chord (as a segment) by more than the tolerance."""
    n = len(x)
    if n < 3:
        return list(range(n))
    stay = np.zeros(n, bool)
    stay[[0, -1]] = True
    spans = [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length, 0, 1) if length else np.zeros(b - a - 1)
        far = np.hypot(px - t * dx, py - t * dy)
        i = int(np.argmax(far))
        if far[i] > tolerance:
            m = a + 1 + i
            stay[m] = True
            spans += [(a, m), (m, b)]
    return np.flatnonzero(stay).tolist()


def _kept(n: int, tolerance: float, distance) -> list[int]:
    """The same for any distance(a, b) of the vertices between a and b from the chord."""
    stay = np.zeros(n, bool)
    stay[[0, -1]] = True
    spans = [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        far = distance(a, b)
        i = int(np.argmax(far))
        if far[i] > tolerance:
            m = a + 1 + i
            stay[m] = True
            spans += [(a, m), (m, b)]
    return np.flatnonzero(stay).tolist()


def kept_by_line(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[int]:
    """By distance from the line through the ends, which has no ends of its own; none where they coincide."""
    if len(x) < 3:
        return list(range(len(x)))

    def distance(a: int, b: int) -> np.ndarray:
        dx, dy = x[b] - x[a], y[b] - y[a]
        return np.abs(dy * (x[a + 1 : b] - x[a]) - dx * (y[a + 1 : b] - y[a])) / (np.hypot(dx, dy) or 1e-9)

    return _kept(len(x), tolerance, distance)


def kept_on_sphere(lon: np.ndarray, lat: np.ndarray, tolerance: float) -> list[int]:
    """By distance, in degrees, from the great circle through the ends; from the first end where they coincide."""
    if len(lon) < 3:
        return list(range(len(lon)))
    la, lo = np.radians(lat), np.radians(lon)
    v = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)

    def distance(a: int, b: int) -> np.ndarray:
        n = np.cross(v[a], v[b])
        length = np.linalg.norm(n)
        return np.abs(v[a + 1 : b] @ n) / length if length > 1e-12 else np.arccos(np.clip(v[a + 1 : b] @ v[a], -1, 1))

    return _kept(len(lon), np.radians(tolerance), distance)


def keep_vertices(tolerance: float, kept=kept):
    @pandas_udf("array<int>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([kept(np.asarray(x, float), np.asarray(y, float), tolerance) for x, y in zip(xs, ys, strict=True)])

    return run
