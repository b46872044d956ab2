"""Connected cells of a raster, and basins that fill from seeds.

Tiles are labelled one by one; only parts that meet at a border between tiles go through
the graph iteration, so that its rounds follow the number of tiles that a pool winds
through, not the length of its path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.operators.graph import components
from geostrata.operators.state import settle

#: Cells of a tile's side.
TILE = 256


def place(row: str | Column = "row", col: str | Column = "col") -> Column:
    """A number that orders cells by row and then column; columns from 0 to 2^32 - 1."""
    row, col = (F.col(x) if isinstance(x, str) else x for x in (row, col))
    return row.cast("long") * (1 << 32) + col


def least_of_each(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches by the edges (a, b): roots hook onto smaller neighbours, then paths are halved."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        least, new = np.minimum(x, y), root.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _label(tile: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        at = np.unique((cells["row"] % tile * tile + cells["col"] % tile).to_numpy())
        number = np.full(tile * tile, -1)
        number[at] = np.arange(len(at))
        right = at[(at % tile < tile - 1)]
        right = right[number[right + 1] >= 0]
        down = at[at < tile * (tile - 1)]
        down = down[number[down + tile] >= 0]
        root = least_of_each(len(at), np.concatenate([number[right], number[down]]), np.concatenate([number[right + 1], number[down + tile]]))
        row = cells["row"].iloc[0] // tile * tile + at // tile
        col = cells["col"].iloc[0] // tile * tile + at % tile
        return pd.DataFrame({"row": row, "col": col, "part": (row * (1 << 32) + col)[root]})

    return run


def pools(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col and pool of each cell: pool is the place of the first cell, by row and column, that neighbours of four join to it.

    cells: row, col of the cells that belong to any pool; repeated ones count once. Labels of parts within tiles don't
    depend on how cells are partitioned. A tile is one task's; parts meet along tile borders.
    """
    at = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    labelled = settle(at.groupBy(F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)).applyInPandas(_label(tile), "row long, col long, part long"))

    def meeting(axis: str) -> DataFrame:
        other = {"row": "col", "col": "row"}[axis]
        first = labelled.where(F.pmod(axis, F.lit(tile)) == tile - 1).select((F.col(axis) + 1).alias(axis), other, F.col("part").alias("a"))
        second = labelled.where(F.pmod(axis, F.lit(tile)) == 0).select(axis, other, F.col("part").alias("b"))
        return first.join(second, [axis, other]).select("a", "b")

    joined = components(meeting("row").unionByName(meeting("col")).distinct())
    return labelled.join(joined, F.col("part") == F.col("node"), "left").select("row", "col", F.coalesce("label", "part").alias("pool"))


def flood(cells: DataFrame, seeds: DataFrame, least: int = 2000, other: int = 3, tile: int = TILE) -> DataFrame:
    """row, col and basin of each cell: the basin of the seeds in its pool (the smallest, if several), else ``other`` in pools of more than ``least`` cells, else 0.

    seeds: row, col, basin; those outside of the cells fill nothing. Basins that fill one after another get what the first leaves, so the smallest number wins.
    """
    labelled = settle(pools(cells, tile))
    filled = labelled.join(seeds.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "basin"), ["row", "col"]).groupBy("pool").agg(F.min("basin").alias("basin"))
    sizes = labelled.groupBy("pool").agg(F.count("*").alias("cells"))
    basins = sizes.join(filled, "pool", "left").select("pool", F.coalesce("basin", F.when(F.col("cells") > least, other), F.lit(0)).alias("basin"))
    return labelled.join(basins, "pool").select("row", "col", "basin")
