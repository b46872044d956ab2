"""Fields over places: projections on a lattice, and random fields that don't depend on any order."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Projection = Callable[[Column, Column], tuple[Column, Column]]


def on_lattice(points: DataFrame, first: str, second: str, step: float, project: Projection, names: tuple[str, str] = ("px", "py")) -> DataFrame:
    """All columns, and a projection of (first, second) that is exact on a lattice of ``step`` and bilinear in between.

    The projection runs once for each corner of the lattice's cells that hold a point, not for each point. Its error is at
    most an eighth of step squared times the sum of the largest second derivatives along both axes. Null places stay null.
    """
    a, b = F.col(first).cast("double") / step, F.col(second).cast("double") / step
    placed = points.withColumn("_i", F.floor(a)).withColumn("_j", F.floor(b)).withColumn("_t", a - F.col("_i")).withColumn("_u", b - F.col("_j"))
    cells = placed.select("_i", "_j").where("_i is not null and _j is not null").distinct()
    corners = {f"_{d}{e}": F.struct(*[v.alias(n) for v, n in zip(project((F.col("_i") + d) * step, (F.col("_j") + e) * step), "xy", strict=True)]) for d in (0, 1) for e in (0, 1)}
    met = placed.join(cells.withColumns(corners), ["_i", "_j"], "left")
    t, u = F.col("_t"), F.col("_u")

    def between(n: str) -> Column:
        row = [(1 - u) * F.col(f"_{d}0.{n}") + u * F.col(f"_{d}1.{n}") for d in (0, 1)]
        return (1 - t) * row[0] + t * row[1]

    return met.withColumns({name: between(n) for name, n in zip(names, "xy", strict=True)}).drop("_i", "_j", "_t", "_u", *corners)


def drawn(seed: int, *counters: Column) -> Column:
    """A number between 0 and 1, neither of them, that seed and counters alone decide: the first 52 bits of their digest."""
    text = F.concat_ws(",", F.lit(str(seed)), *[c.cast("long").cast("string") for c in counters])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def normal(seed: int, *counters: Column) -> Column:
    """A standard normal number that seed and counters alone decide: two uniform ones as radius and angle."""
    radius, angle = drawn(seed, *counters, F.lit(0)), drawn(seed, *counters, F.lit(1))
    return F.sqrt(-2 * F.log(radius)) * F.cos(2 * math.pi * angle)


def value_noise(seed: int, row: Column, col: Column, period: float, octaves: int = 1) -> Column:
    """Noise between 0 and 1 that is smooth over ``period`` cells: values drawn at the nodes of a lattice, with eased steps between them.

    Each further octave has half the period and half the weight.
    """
    total, weight = F.lit(0.0), 0.0
    for k in range(octaves):
        y, x = row / (period / 2**k), col / (period / 2**k)
        i, j = F.floor(y), F.floor(x)
        t, u = (v * v * (3 - 2 * v) for v in (y - i, x - j))
        node = lambda d, e, i=i, j=j, k=k: drawn(seed + k, i + d, j + e)
        total = total + 0.5**k * ((1 - t) * ((1 - u) * node(0, 0) + u * node(0, 1)) + t * ((1 - u) * node(1, 0) + u * node(1, 1)))
        weight += 0.5**k
    return total / weight
