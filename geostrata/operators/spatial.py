"""Joins of segments by place, without pairs that lie apart and without duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions import expressions as E

#: Share of a cell by which boxes are widened, so that roundings can't part what meets on a border.
EDGE = 1e-6
#: Sides of the cells by which rows are dealt out, in the caller's: a segment lies in about one of them, so that it is shuffled about once.
SPREAD = 4


def _count(names: tuple[str, ...], cell: float) -> Column:
    """Equal pieces no longer than a cell that a segment is cut into."""
    x, y, x2, y2 = (F.col(c).cast("double") for c in names)
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(x2 - x), F.abs(y2 - y)) / cell)).cast("long")


def _pieces(segments: DataFrame, names: tuple[str, ...], cell: float, side: str) -> DataFrame:
    """Each segment's pieces by number, each in every cell that its box touches, marked in those that are first along x (1) and along y (2)."""
    x, y, x2, y2 = (F.col(c).cast("double") for c in names)
    d = segments.withColumn("_n", _count(names, cell)).withColumn(f"_i{side}", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    share = lambda k: (F.col(f"_i{side}") + k) / F.col("_n")

    def cells(a: Column, b: Column) -> tuple[Column, Column]:
        ends = [a + (b - a) * share(k) for k in (0, 1)]
        return F.floor(F.least(*ends) / cell - EDGE), F.floor(F.greatest(*ends) / cell + EDGE)

    (left, right), (low, high) = cells(x, x2), cells(y, y2)
    d = d.select("*", left.alias("_left"), right.alias("_right"), low.alias("_low"), high.alias("_high"))
    d = d.withColumn("_cx", F.explode(F.sequence("_left", "_right"))).withColumn("_cy", F.explode(F.sequence("_low", "_high")))
    first = F.when(F.col("_cx") == F.col("_left"), 1).otherwise(0) + F.when(F.col("_cy") == F.col("_low"), 2).otherwise(0)
    return d.withColumn(f"_f{side}", first).drop("_n", "_left", "_right", "_low", "_high")


def crossing_pairs(left: DataFrame, right: DataFrame, cell: float, a: tuple[str, ...] = ("x", "y", "x2", "y2"), b: tuple[str, ...] = ("sx", "sy", "sx2", "sy2")) -> DataFrame:
    """All columns of both (names must differ), t and s of every pair of segments that cross: the places along left and right, from 0 to 1.

    Segments are cut into pieces, and pieces meet where they touch the same cell of a grid (``SPREAD`` cells wide) and their
    segments' boxes meet; a pair of pieces counts in the first cell that both touch, a crossing in the pair of pieces that
    holds it. Parallel segments don't cross. The result is the same for every ``cell``, whose size only decides the work:
    about the length of the longer kind of segments.
    """
    wide = cell * SPREAD
    # Merged at every size: both sides grow, and no side goes through the driver.
    met = _pieces(left, a, wide, "l").join(_pieces(right, b, wide, "r").hint("merge"), ["_cx", "_cy"]).where(F.col("_fl").bitwiseOR(F.col("_fr")) == 3)
    ends = [F.col(n).cast("double") for n in (*a, *b)]
    for p, q, u, v in (ends[0::2], ends[1::2]):  # along x, then along y
        met = met.where((F.greatest(p, q) >= F.least(u, v) - EDGE * wide) & (F.least(p, q) <= F.greatest(u, v) + EDGE * wide))
    t, s = E.crossing(*ends)
    # Generated, not projected: the optimizer would write both formulas out for every comparison in the join condition.
    met = met.select("*", F.inline(F.array(F.struct(t.alias("t"), s.alias("s")))))
    hit = met.where("t between 0 and 1 and s between 0 and 1")
    held = lambda place, names, side: F.least(F.floor(place * _count(names, wide)), _count(names, wide) - 1) == F.col(f"_i{side}")
    return hit.where(held(F.col("t"), a, "l") & held(F.col("s"), b, "r")).drop(*[f"_{k}{side}" for k in "fi" for side in "lr"], "_cx", "_cy")
