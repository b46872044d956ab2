"""Rasters as long tables (row, col, value): filling, labelling, resampling, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators.relational import asof_backward


#: Rows whose centre lines cross an edge; its lower end belongs to it, its upper end doesn't.
SCANLINES = "filter(sequence(cast(ceil(least(y, y2) - 0.5) as bigint), cast(ceil(greatest(y, y2) - 0.5) as bigint)), r -> r + 0.5 >= least(y, y2) and r + 0.5 < greatest(y, y2))"


def cells(spark, rows: int, cols: int) -> DataFrame:
    """Every (row, col) of a grid."""
    return spark.range(rows).withColumnRenamed("id", "row").join(spark.range(cols).withColumnRenamed("id", "col"))


def fill_even_odd(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col) of cells whose centres lie inside by the even-odd rule; holes stay open.

    edges: keys, x, y, x2, y2 in cell units. Crossings of each scanline are paired by rank, and a pair is a run of cells.
    """
    lines = edges.where("y <> y2").withColumn("row", F.explode(F.expr(SCANLINES)))
    crossed = lines.withColumn("cx", F.expr("x + (row + 0.5 - y) * (x2 - x) / (y2 - y)"))
    w = Window.partitionBy(*keys, "row").orderBy("cx")
    pairs = crossed.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("cx").over(w)).where("k % 2 = 1 and next is not null")
    run = pairs.withColumn("c0", F.expr("cast(ceil(cx - 0.5) as bigint)")).withColumn("c1", F.expr("cast(ceil(next - 0.5) as bigint) - 1")).where("c1 >= c0")
    return run.select(*keys, "row", F.explode(F.sequence("c0", "c1")).alias("col")).distinct()


def label_scanlines(grid: DataFrame, arcs: DataFrame, label: str) -> DataFrame:
    """Each cell centre takes the label of the last crossing at or west of it in its row; 0 where there is none."""
    lines = arcs.where("y <> y2").withColumn("row", F.explode(F.expr(SCANLINES)))
    crossed = lines.select("row", F.expr("x + (row + 0.5 - y) * (x2 - x) / (y2 - y)").alias("px"), label)
    points = grid.select("row", (F.col("col") + 0.5).alias("px"), "col")
    return asof_backward(points, crossed, ["row"], "px", [label], tie=label).withColumn(label, F.coalesce(label, F.lit(0))).select("row", "col", label)


def block_mean(grid: DataFrame, rows: int, cols: int, ny: int, nx: int) -> DataFrame:
    """Means of an ny by nx partition of the grid."""
    by = F.floor(F.col("row") * ny / rows).alias("by")
    bx = F.floor(F.col("col") * nx / cols).alias("bx")
    return grid.groupBy(by, bx).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def box_pass(grid: DataFrame, along: str, across: str, size: int, radius: int) -> DataFrame:
    """Moving mean of 2 * radius + 1 cells along one axis, edge cells repeated outwards."""
    copies = F.when(F.col(along) == 0, F.sequence(F.lit(-radius), F.lit(0))).when(F.col(along) == size - 1, F.sequence(F.lit(size - 1), F.lit(size - 1 + radius))).otherwise(F.array(F.col(along).cast("int")))
    padded = grid.select(across, F.explode(copies).alias("_at"), "value").select(across, F.col("_at").cast("long").alias(along), "value")
    w = Window.partitionBy(across).orderBy(along).rowsBetween(-radius, radius)
    return padded.withColumn("value", F.avg("value").over(w)).where(F.col(along).between(0, size - 1)).select("row", "col", "value")


def box_blur(grid: DataFrame, rows: int, cols: int, radius: int, passes: int = 3) -> DataFrame:
    """Repeated box passes on both axes, near to a Gaussian. Passes along one axis leave the other alone, so that all of an axis come in one exchange."""
    for along, across, size in (("col", "row", cols), ("row", "col", rows)):
        for _ in range(passes):
            grid = box_pass(grid, along, across, size, radius)
    return grid


def gradient(grid: DataFrame) -> DataFrame:
    """Central differences, clamped at the edges."""
    wx, wy = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")

    def side(f, w) -> Column:
        return F.coalesce(f("value").over(w), F.col("value"))

    return grid.withColumn("gx", (side(F.lead, wx) - side(F.lag, wx)) / 2.0).withColumn("gy", (side(F.lead, wy) - side(F.lag, wy)) / 2.0)


def hillshade(grid: DataFrame, cell: float, azimuth: float, altitude: float) -> DataFrame:
    """row, col and shade (0 to 1) of a surface lit from an azimuth, clockwise from north, and an altitude, in degrees; rows run south."""
    az, alt = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    gx, gy = F.col("gx") / cell, F.col("gy") / cell
    light = (-gx * F.cos(alt) * F.sin(az) + gy * F.cos(alt) * F.cos(az) + F.sin(alt)) / F.sqrt(1 + gx * gx + gy * gy)
    return gradient(grid).select("row", "col", F.greatest(F.lit(0.0), light).alias("shade"))


def window(grid: DataFrame, frame: DataFrame) -> DataFrame:
    """Cells of ``grid`` inside the window of ``frame`` (one row: row0, col0, rows, cols), numbered from its corner."""
    inside = (F.col("row") >= F.col("row0")) & (F.col("row") < F.col("row0") + F.col("rows")) & (F.col("col") >= F.col("col0")) & (F.col("col") < F.col("col0") + F.col("cols"))
    return grid.join(F.broadcast(frame), inside).select((F.col("row") - F.col("row0")).alias("row"), (F.col("col") - F.col("col0")).alias("col"), "value")


def _four(points: DataFrame, grid: DataFrame, x: Column, y: Column, left: Column, top: Column, cols: int | None) -> DataFrame:
    """Each point with the weighted mean of the four cells around (x, y); null unless all four are there. Equal points are reckoned once."""
    at = points.select("x", "y").dropna().distinct().select("*", left.alias("_c"), top.alias("_r"), (x - left).alias("_u"), (y - top).alias("_v"))
    corners = F.explode(F.expr("transform(sequence(0, 3), i -> struct(i % 2 as dx, i div 2 as dy, if(i % 2 = 1, _u, 1 - _u) * if(i div 2 = 1, _v, 1 - _v) as w))"))
    col = F.col("_c") + F.col("_k.dx")
    spread = at.select("x", "y", "_c", "_r", "_u", "_v", corners.alias("_k")).select("x", "y", F.col("_k.w").alias("_w"), (col if cols is None else F.pmod(col, F.lit(cols))).cast("long").alias("col"), (F.col("_r") + F.col("_k.dy")).cast("long").alias("row"))
    met = spread.join(grid.select("row", "col", "value"), ["row", "col"]).groupBy("x", "y").agg(F.sum(F.col("_w") * F.col("value")).alias("value"), F.count("value").alias("_n"))
    return points.join(met.where("_n = 4").select("x", "y", "value"), ["x", "y"], "left").select(*points.columns, "value")


def bilinear(points: DataFrame, grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """Value of a grid of points at (x, y) in cell units: null outside, and where a cell around is missing."""
    x, y = F.col("x"), F.col("y")
    inside = x.between(0, cols - 1) & y.between(0, rows - 1)
    return _four(points, grid, x, y, F.when(inside, F.least(F.floor(x), F.lit(cols - 2))), F.when(inside, F.least(F.floor(y), F.lit(rows - 2))), None)


def bilinear_round(points: DataFrame, grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """As ``bilinear`` on a grid around the globe: columns go on from the first, and rows beyond an edge count as just within it."""
    x, y = F.col("x"), F.least(F.greatest(F.col("y"), F.lit(0.0)), F.lit(rows - 1.001))
    return _four(points, grid, x, y, F.floor(x), F.floor(y), cols)


def nearest(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Value of the cell whose centre is nearest to (x, y) in cell units, the one to the south-east of ties; null where there is none."""
    cell = points.withColumn("_row", F.floor(F.col("y") + 0.5)).withColumn("_col", F.floor(F.col("x") + 0.5))
    g = grid.select(F.col("row").alias("_row"), F.col("col").alias("_col"), "value")
    return cell.join(g, ["_row", "_col"], "left").select(*points.columns, "value")


def overlay(fine: DataFrame, coarse: DataFrame, fallback: list[int]) -> DataFrame:
    """The fine class where there is one that is no fallback code, else the coarse class."""
    f = fine.select("row", "col", F.col("cls").alias("fine"))
    return coarse.join(f, ["row", "col"], "left").withColumn("cls", F.when(F.col("fine").isNotNull() & ~F.col("fine").isin(fallback), F.col("fine")).otherwise(F.col("cls"))).select("row", "col", "cls")
