"""Queries over grids, polygons and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.functions import expressions as E
from geostrata.operators import raster
from geostrata.operators.relational import nearest_rank, runs, share
from geostrata.plans.bindings import EDGES, GRID, INSIDE, POINTS, edges, grid, points
from geostrata.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.fill_even_odd(edges(spark, sf_dir), ["poly"])


@query(f"""WITH {EDGES}, {INSIDE}, {GRID}, m AS (SELECT poly, cls, value FROM mask JOIN grid USING (row, col)),
shares AS (SELECT poly, cls, count(*) AS cells, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY poly) AS pct FROM m GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY poly ORDER BY pct DESC, cls) AS rank FROM shares WHERE pct >= 2),
s AS (SELECT poly, value, row_number() OVER (PARTITION BY poly ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY poly) AS n FROM m),
q AS (SELECT poly, max(CASE WHEN r = round_even(0.1 * (n - 1), 0) THEN value END) AS p10, max(CASE
WHEN r = round_even(0.5 * (n - 1), 0) THEN value END) AS p50, max(CASE WHEN r = round_even(0.9 * (n - 1), 0) THEN value END) AS p90 FROM s GROUP BY 1)
SELECT poly, cls, cells, round(pct, 6) AS pct, CAST(rank AS INT) AS rank, p10, p50, p90 FROM ranked JOIN q USING (poly) WHERE rank <= 6""")
def area_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of classes of 2 % or more, six at most, and nearest-rank quantiles inside each area."""
    counts = mask(spark, sf_dir).join(grid(spark, sf_dir), ["row", "col"]).groupBy("poly", "cls", "value").agg(F.count("*").alias("n"))  # shares and quantiles both come from these
    shares = counts.groupBy("poly", "cls").agg(F.sum("n").alias("cells")).withColumn("pct", share(F.col("cells"), ["poly"])).where("pct >= 2")
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("poly").orderBy(F.desc("pct"), "cls"))).where("rank <= 6")
    q = nearest_rank(counts, ["poly"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, "n")
    return ranked.join(q, "poly").select("poly", "cls", "cells", F.round("pct", 6).alias("pct"), "rank", "p10", "p50", "p90")


@query(f"WITH {EDGES}, {INSIDE} SELECT poly, count(*) AS cells, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1 FROM mask GROUP BY 1")
def polygon_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(spark, sf_dir).groupBy("poly").agg(F.count("*").alias("cells"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


@query(f"""WITH {EDGES}, cells AS (SELECT r.range AS row, c.range AS col FROM range(64) r, range(64) c),
hits AS (SELECT c.row, c.col, e.poly + 1 AS label, row_number() OVER (PARTITION BY c.row, c.col
ORDER BY e.x + (c.row + 0.5 - e.y) * (e.x2 - e.x) / (e.y2 - e.y) DESC, e.poly DESC) AS k
 FROM cells c JOIN edges e ON e.y <> e.y2 AND c.row + 0.5 >= least(e.y, e.y2) AND c.row + 0.5 < greatest(e.y, e.y2)
AND e.x + (c.row + 0.5 - e.y) * (e.x2 - e.x) / (e.y2 - e.y) <= c.col + 0.5)
SELECT c.row, c.col, coalesce(h.label, 0) AS label FROM cells c LEFT JOIN hits h ON h.row = c.row AND h.col = c.col AND h.k = 1""")
def scanline_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = edges(spark, sf_dir).withColumn("label", F.col("poly") + 1)
    return raster.label_scanlines(raster.cells(spark, 64, 64), arcs, "label")


@query(f"""WITH {EDGES}, p AS (SELECT c_custkey, (c_custkey * 7919 % 640 + 0.25) / 10 AS px, (c_custkey * 104729 % 640 + 0.25) / 10 AS py FROM customer)
SELECT c_custkey, poly FROM p JOIN edges ON (y > py) <> (y2 > py) AND px < (x2 - x) * (py - y) / (y2 - y) + x GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def point_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points meet the few polygons' edges by the unit row that they share, not by comparing all."""
    p = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 640 + 0.25) / 10).alias("px"), ((F.col("c_custkey") * 104729 % 640 + 0.25) / 10).alias("py")).withColumn("band", F.floor("py"))
    e = edges(spark, sf_dir).where("y <> y2").withColumn("band", F.explode(F.expr("sequence(cast(least(y, y2) as bigint), cast(greatest(y, y2) as bigint))")))
    hit = ((F.col("y") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < (F.col("x2") - F.col("x")) * (F.col("py") - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x"))
    return p.join(e, "band").where(hit).groupBy("c_custkey", "poly").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select("c_custkey", "poly")


SEGMENTS = POINTS + ", seg AS (SELECT line, seq, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY line ORDER BY seq))"


@query(f"""WITH {SEGMENTS}, s AS (SELECT *, (400.0 - y) / (y2 - y) AS s FROM seg WHERE x2 IS NOT NULL AND y <> y2)
SELECT line, seq, round(x + s * (x2 - x), 4) AS at FROM s WHERE s >= 0 AND s < 1 AND x + s * (x2 - x) BETWEEN 100 AND 600""")
def section_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines cross the section from (100, 400) to (600, 400)."""
    w = Window.partitionBy("line").orderBy("seq")
    seg = points(spark, sf_dir).withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 is not null and y <> y2")
    s = (F.lit(400.0) - F.col("y")) / (F.col("y2") - F.col("y"))
    at = F.col("x") + s * (F.col("x2") - F.col("x"))
    return seg.where((s >= 0) & (s < 1) & at.between(100, 600)).select("line", "seq", F.round(at, 4).alias("at"))


@query("""WITH ends AS (SELECT l_orderkey AS line, min({'n': l_linenumber, 'p': l_partkey}).p AS a, max({'n': l_linenumber, 'p': l_partkey}).p AS b
FROM lineitem GROUP BY 1)
SELECT u.line AS up, d.line AS down FROM ends u JOIN ends d ON u.b = d.a AND u.line <> d.line""")
def endpoint_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin where others end; the end points are parts, of which there are more as the lines grow."""
    step = F.struct("l_linenumber", "l_partkey")
    ends = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line")).agg(F.min(step)["l_partkey"].alias("a"), F.max(step)["l_partkey"].alias("b"))
    up, down = ends.select(F.col("line").alias("up"), "b"), ends.select(F.col("line").alias("down"), F.col("a").alias("b"))
    return up.join(down, "b").where("up <> down").select("up", "down")


@query(f"""WITH {GRID} SELECT c_custkey, CASE WHEN px < 0 OR py < 0 THEN NULL ELSE cls END AS cls FROM
(SELECT c_custkey, (c_custkey * 7919 % 800) / 10.0 - 5 AS px, (c_custkey * 104729 % 800) / 10.0 - 5 AS py FROM customer) p LEFT
JOIN grid ON floor(px) = col AND floor(py) = row""")
def point_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select("c_custkey", F.floor((F.col("c_custkey") * 7919 % 800) / 10.0 - 5).alias("col"), F.floor((F.col("c_custkey") * 104729 % 800) / 10.0 - 5).alias("row"))
    return p.join(grid(spark, sf_dir).select("row", "col", "cls"), ["row", "col"], "left").select("c_custkey", "cls")


@query("""WITH s AS (SELECT s_suppkey, s_suppkey * 7919 % 1000 AS sx, s_suppkey * 104729 % 1000 AS sy FROM supplier), c AS (SELECT c_custkey,
c_custkey * 7919 % 1000 AS cx, c_custkey * 31337 % 1000 AS cy FROM customer)
SELECT s_suppkey, min((sx - cx) * (sx - cx) + (sy - cy) * (sy - cy)) AS d2 FROM s JOIN c ON abs(sx - cx) <= 50 AND abs(sy - cy) <= 50
AND (sx - cx) * (sx - cx) + (sy - cy) * (sy - cy) <= 2500 GROUP BY 1""")
def nearest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance to the nearest point within 50, by buckets of 50: each point looks into nine."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7919 % 1000).alias("sx"), (F.col("s_suppkey") * 104729 % 1000).alias("sy"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7919 % 1000).alias("cx"), (F.col("c_custkey") * 31337 % 1000).alias("cy")).distinct()  # places, of which a bucket holds 2,500 at most
    c = c.withColumn("bx", F.floor(F.col("cx") / 50)).withColumn("by_", F.floor(F.col("cy") / 50))
    around = "explode(transform(sequence(0, 8), i -> struct(floor(sx / 50) + i % 3 - 1 as bx, floor(sy / 50) + i div 3 - 1 as by_)))"
    s = s.withColumn("k", F.expr(around)).select("s_suppkey", "sx", "sy", F.col("k.bx").alias("bx"), F.col("k.by_").alias("by_"))
    d2 = (F.col("sx") - F.col("cx")) * (F.col("sx") - F.col("cx")) + (F.col("sy") - F.col("cy")) * (F.col("sy") - F.col("cy"))
    return s.join(c, ["bx", "by_"]).withColumn("d2", d2).where("d2 <= 2500").groupBy("s_suppkey").agg(F.min("d2").alias("d2"))


@query(f"""WITH {GRID}, fine AS (SELECT row, col, n % 5 AS f FROM grid WHERE (row + col) % 3 <> 0)
SELECT g.row, g.col, CASE WHEN f IS NOT NULL AND f NOT IN (0, 4) THEN f ELSE cls END AS cls FROM grid g LEFT JOIN fine ON g.row = fine.row
AND g.col = fine.col""")
def overlay_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    fine = g.where("(row + col) % 3 <> 0").select("row", "col", (F.col("n") % 5).alias("cls"))
    return raster.overlay(fine, g.select("row", "col", "cls"), [0, 4])


@query(f"""WITH {GRID}, w AS (SELECT row, col, value, least(1.0, least(row, col, 63 - row, 63 - col) / 8.0) AS w,
avg(value) OVER (PARTITION BY CAST(floor(row / 4) AS INT), CAST(floor(col / 4) AS INT)) AS coarse FROM grid)
SELECT row, col, round(coarse * (1 - w) + value * w, 4) AS value FROM w""")
def feather_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fine grid blended into its 4 by 4 means by distance to the edge."""
    g = grid(spark, sf_dir)
    coarse = g.groupBy(F.floor(F.col("row") / 4).alias("br"), F.floor(F.col("col") / 4).alias("bc")).agg(F.avg("value").alias("coarse"))
    w = F.least(F.lit(1.0), F.least("row", "col", 63 - F.col("row"), 63 - F.col("col")) / 8.0)
    both = g.withColumn("br", F.floor(F.col("row") / 4)).withColumn("bc", F.floor(F.col("col") / 4)).join(coarse, ["br", "bc"])
    return both.select("row", "col", F.round(F.col("coarse") * (1 - w) + F.col("value") * w, 4).alias("value"))


@query(f"WITH {GRID} SELECT cls, max(value) AS high, arg_max(row * 64 + col, value * 10000 - (row * 64 + col)) AS at, min(value) AS low, count(*) FILTER (WHERE value < 100) AS few FROM grid GROUP BY 1")
def argmax_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of each class; the first cell wins among equals."""
    at = F.col("row") * 64 + F.col("col")
    return grid(spark, sf_dir).groupBy("cls").agg(F.max("value").alias("high"), F.max_by(at, F.struct(F.col("value"), -at)).alias("at"), F.min("value").alias("low"), F.count_if(F.col("value") < 100).alias("few"))


@query(f"WITH {GRID} SELECT CAST(floor(row * 10 / 64.0) AS BIGINT) AS by, CAST(floor(col * 12 / 64.0) AS BIGINT) AS bx, round(avg(value), 6) AS mean, count(*) AS n FROM grid GROUP BY 1, 2".replace("AS by", 'AS "by"'))
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.block_mean(grid(spark, sf_dir), 64, 64, 10, 12).withColumn("mean", F.round("mean", 6))


@query(f"WITH {EDGES}, {INSIDE}, {GRID} SELECT poly, cls, round(sum(value) * 0.0002471, 6) AS acres FROM mask JOIN grid USING (row, col) WHERE cls IN (1, 3) GROUP BY 1, 2")
def mask_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(spark, sf_dir).join(grid(spark, sf_dir).where("cls in (1, 3)"), ["row", "col"]).groupBy("poly", "cls").agg(F.round(F.sum("value") * 0.0002471, 6).alias("acres"))


@query(f"""WITH {EDGES} SELECT poly, min(least(x, x2)) AS x0, max(greatest(x, x2)) AS x1, min(least(y, y2)) AS y0, max(greatest(y, y2)) AS y1, abs(sum(CASE
WHEN ring = 0 THEN x * y2 - x2 * y ELSE 0 END)) / 2.0 - abs(sum(CASE WHEN ring = 1 THEN x * y2 - x2 * y ELSE 0 END)) / 2.0 AS area,
round(sum(CASE WHEN ring = 0 THEN (x + x2) * (x * y2 - x2 * y) ELSE 0 END) / (3.0 * sum(CASE WHEN ring = 0 THEN x * y2 - x2 * y ELSE 0 END)), 6) AS cx
FROM edges GROUP BY 1""")
def ring_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, shoelace area less the hole's, and the outer ring's centroid."""
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    outer, hole = F.when(F.col("ring") == 0, cross).otherwise(0), F.when(F.col("ring") == 1, cross).otherwise(0)
    moment = F.when(F.col("ring") == 0, (F.col("x") + F.col("x2")) * cross).otherwise(0)
    return edges(spark, sf_dir).groupBy("poly").agg(F.min(F.least("x", "x2")).alias("x0"), F.max(F.greatest("x", "x2")).alias("x1"), F.min(F.least("y", "y2")).alias("y0"), F.max(F.greatest("y", "y2")).alias("y1"), (F.abs(F.sum(outer)) / 2.0 - F.abs(F.sum(hole)) / 2.0).alias("area"), F.round(F.sum(moment) / (3.0 * F.sum(outer)), 6).alias("cx"))


def _blur_sql(passes: int, radius: int) -> str:
    """Means over clamped neighbours, by a self-join: independent of the padded window."""
    out, last = [], "grid"
    for i in range(passes):
        for axis, other in (("col", "row"), ("row", "col")):
            name = f"b{i}{axis}"
            out.append(f"{name} AS (SELECT g.row, g.col, avg(n.value) AS value FROM {last} g, range({-radius}, {radius + 1}) d JOIN {last} n ON n.{other} = g.{other} AND n.{axis} = greatest(0, least(63, g.{axis} + d.range)) GROUP BY 1, 2)")
            last = name
    return ", ".join(out) + f" SELECT row, col, round(value, 4) AS value FROM {last}"


@query(f"WITH {GRID}, " + _blur_sql(3, 2))
def box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.box_blur(grid(spark, sf_dir).select("row", "col", "value"), 64, 64, 2).withColumn("value", F.round("value", 4))


NOISE_SQL = "grid AS (SELECT row, col, s - floor(s) - 0.5 AS value FROM (SELECT row, col, sin(col * 12.9898::DOUBLE + row * 78.233::DOUBLE) * 43758.5453::DOUBLE AS s FROM field))"


@query(f"""WITH {GRID.replace("grid AS", "field AS")}, smooth AS (WITH {NOISE_SQL}, {_blur_sql(1, 2)})
SELECT row, col, round(least(8.0, greatest(2.4, 8.0 + (2.6 - 8.0) * (1 - (row + 0.5::DOUBLE) / 64) + 0.5 * value / (SELECT max(abs(value)) + 1e-9::DOUBLE
FROM smooth))), 4) AS age FROM smooth""")
def eruption_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages from 8.0 in the south to 2.6 in the north, moved by up to half a million years of smooth noise."""
    noise = grid(spark, sf_dir).select("row", "col", (E.cell_noise(F.col("row"), F.col("col")) - 0.5).alias("value"))
    smooth = raster.box_blur(noise, 64, 64, 2, passes=1).withColumn("value", F.round("value", 4))
    most = smooth.agg((F.max(F.abs("value")) + 1e-9).alias("most"))  # one row
    age = E.age_ramp(F.col("row"), 64, 8.0, 2.6, 0.5 * F.col("value") / F.col("most"), (2.4, 8.0))
    return smooth.join(F.broadcast(most)).select("row", "col", F.round(age, 4).alias("age"))


@query(f"""WITH {GRID}, p AS (SELECT g.row, g.col, avg(n.value) AS v FROM grid g, range(-3, 4) d JOIN grid n ON n.row = g.row AND n.col = greatest(0, least(63,
g.col + d.range)) GROUP BY 1, 2)
SELECT row, col, round(v, 6) AS value FROM p WHERE col % 4 = 0""")
def smooth_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.box_pass(grid(spark, sf_dir), "col", "row", 64, 3).where("col % 4 = 0").withColumn("value", F.round("value", 6))


@query(f"""WITH {GRID} SELECT row, col, (coalesce(lead(value) OVER (PARTITION BY row ORDER BY col), value) - coalesce(lag(value) OVER (PARTITION BY row
ORDER BY col), value)) / 2.0 AS gx,
(coalesce(lead(value) OVER (PARTITION BY col ORDER BY row), value) - coalesce(lag(value) OVER (PARTITION BY col ORDER BY row), value)) / 2.0 AS gy
FROM grid""")
def hillshade_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.gradient(grid(spark, sf_dir)).select("row", "col", "gx", "gy")


@query(f"""WITH {GRID}, f AS (SELECT row, min(CASE WHEN value > 400 THEN col END) AS land FROM grid GROUP BY 1)
SELECT g.row, land, max(CASE WHEN g.col < land AND g.value < 300 THEN g.col END) AS deep, arg_min(g.col, g.value * 100 + g.col) AS lowest FROM grid g
JOIN f ON g.row = f.row GROUP BY 1, 2""")
def first_deep_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By row: the first loud column, the last quiet one before it, and the lowest."""
    w = Window.partitionBy("row")
    g = grid(spark, sf_dir).withColumn("land", F.min(F.when(F.col("value") > 400, F.col("col"))).over(w))
    return g.groupBy("row", "land").agg(F.max(F.when((F.col("col") < F.col("land")) & (F.col("value") < 300), F.col("col"))).alias("deep"), F.min_by("col", F.struct("value", "col")).alias("lowest"))


@query(f"""WITH {GRID}, p AS (SELECT c_custkey, (c_custkey * 7919 % 700) / 10.0 - 3 AS x, (c_custkey * 104729 % 700) / 10.0 - 3 AS y FROM customer),
q AS (SELECT *, least(floor(x), 62) AS c0, least(floor(y), 62) AS r0 FROM p WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63)
SELECT p.c_custkey, round(a.value * (1 - (q.x - c0)) * (1 - (q.y - r0)) + b.value * (q.x - c0) * (1 - (q.y - r0)) + c.value * (1 - (q.x - c0)) * (q.y - r0) + d.value * (q.x - c0) * (q.y - r0), 6) AS value
FROM p LEFT JOIN q ON p.c_custkey = q.c_custkey LEFT JOIN grid a ON a.row = r0 AND a.col = c0 LEFT JOIN grid b ON b.row = r0 AND b.col = c0 + 1 LEFT
JOIN grid c ON c.row = r0 + 1 AND c.col = c0 LEFT JOIN grid d ON d.row = r0 + 1 AND d.col = c0 + 1""")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 700) / 10.0 - 3).alias("x"), ((F.col("c_custkey") * 104729 % 700) / 10.0 - 3).alias("y"))
    return raster.bilinear(p, grid(spark, sf_dir), 64, 64).select("c_custkey", F.round("value", 6).alias("value"))


@query(f"""WITH {SEGMENTS}, steps AS (SELECT CAST(round_even(x / 16.0 + (x2 - x) / 16.0 * k.range / 8.0, 0) AS BIGINT) AS col,
CAST(round_even(y / 16.0 + (y2 - y) / 16.0 * k.range / 8.0, 0) AS BIGINT) AS row FROM seg, range(9) k WHERE x2 IS NOT NULL)
SELECT DISTINCT row + dr.range AS row, col + dc.range AS col FROM steps, range(-1, 2) dr, range(-1, 2) dc""")
def line_brush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a brush of three by three touches along lines, sampled eight times a segment."""
    w = Window.partitionBy("line").orderBy("seq")
    seg = points(spark, sf_dir).withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 is not null")
    at = lambda a, b: F.bround(F.col(a) / 16.0 + (F.col(b) - F.col(a)) / 16.0 * F.col("k") / 8.0).cast("long")
    steps = seg.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).select(at("y", "y2").alias("r"), at("x", "x2").alias("c")).distinct()
    brush = F.expr("explode(transform(sequence(0, 8), i -> struct(r + i % 3 - 1 as row, c + i div 3 - 1 as col)))")
    return steps.select(brush.alias("b")).select("b.row", "b.col").distinct()


@query(f"""WITH {EDGES}, {INSIDE}, {GRID} SELECT poly, cls, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY cls), 6) AS pct FROM mask
JOIN grid USING (row, col) GROUP BY 1, 2""")
def area_share_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = mask(spark, sf_dir).join(grid(spark, sf_dir), ["row", "col"]).groupBy("poly", "cls").agg(F.count("*").alias("k"))
    return both.select("poly", "cls", F.round(share(F.col("k"), ["cls"]), 6).alias("pct"))


@query(f"""WITH {GRID}, r AS (SELECT row, col, cls, CASE WHEN lag(cls) OVER (PARTITION BY row ORDER BY col) = cls THEN 0 ELSE 1 END AS new FROM grid),
s AS (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY col) AS run FROM r)
SELECT row, min(col) AS from_col, max(col) AS to_col, cls FROM s GROUP BY row, run, cls""")
def class_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("row").orderBy("col")
    g = runs(grid(spark, sf_dir), ["row"], ["col"], F.lag("cls").over(w) != F.col("cls"))
    return g.groupBy("row", "run", "cls").agg(F.min("col").alias("from_col"), F.max("col").alias("to_col")).select("row", "from_col", "to_col", "cls")


@query(f"""WITH {POINTS}, i AS (SELECT *, x BETWEEN 200 AND 800 AND y BETWEEN 200 AND 800 AS inside FROM pts), g AS (SELECT *, sum(CASE
WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY line ORDER BY seq) AS grp FROM i)
SELECT line, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM g WHERE inside GROUP BY line, grp HAVING count(*) > 1""")
def inside_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more consecutive vertices inside a box."""
    inside = F.col("x").between(200, 800) & F.col("y").between(200, 800)
    g = runs(points(spark, sf_dir).withColumn("inside", inside), ["line"], ["seq"], ~F.col("inside"))
    return g.where("inside").groupBy("line", "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n")).where("n > 1").drop("run")


@query(f"""WITH {POINTS}, b AS (SELECT line, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, bool_or(x BETWEEN 100 AND 400 AND y BETWEEN 100
AND 400) AS touches FROM pts GROUP BY 1)
SELECT line, x0 >= 100 AND x1 <= 900 AND y0 >= 100 AND y1 <= 900 AS contained, touches, x0 <= 150 AND x1 >= 50 AND y0 <= 150 AND y1 >= 50 AS near
FROM b""")
def frame_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds inside the frame, any vertex inside, bounds overlap (touching counts)."""
    touch = F.col("x").between(100, 400) & F.col("y").between(100, 400)
    b = points(spark, sf_dir).groupBy("line").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.bool_or(touch).alias("touches"))
    return b.selectExpr("line", "x0 >= 100 and x1 <= 900 and y0 >= 100 and y1 <= 900 as contained", "touches", "x0 <= 150 and x1 >= 50 and y0 <= 150 and y1 >= 50 as near")


@query(f"""WITH {POINTS}, d AS (SELECT line, seq, x, y, x - lag(x, 1, 0) OVER w AS dx, y - lag(y, 1, 0) OVER w AS dy,
((x - lag(x, 1, 0) OVER w) % 65536 + 65536) % 65536 AS dx16, lag(x) OVER w = x AND lag(y) OVER w = y AS same FROM pts WINDOW w AS (PARTITION BY line
ORDER BY seq))
SELECT line, seq, dx, dy, dx16, x AS back_x, coalesce(same, false) AS repeated FROM d""")
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta coding, its 16-bit form, decoding by running sums, and repeats of the vertex before."""
    w = Window.partitionBy("line").orderBy("seq")
    d = points(spark, sf_dir).withColumn("dx", F.col("x") - F.lag("x", 1, 0).over(w)).withColumn("dy", F.col("y") - F.lag("y", 1, 0).over(w))
    same = (F.lag("x").over(w) == F.col("x")) & (F.lag("y").over(w) == F.col("y"))
    return d.select("line", "seq", "dx", "dy", F.pmod("dx", F.lit(65536)).alias("dx16"), F.sum("dx").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("back_x"), F.coalesce(same, F.lit(False)).alias("repeated"))


@query(f"""WITH {GRID} SELECT cls, CAST(row_number() OVER (ORDER BY count(*) DESC, min(row * 64 + col)) - 1 AS BIGINT) AS code, count(*) AS cells FROM grid
GROUP BY 1""")
def rank_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes numbered by area; the window sees one row a class."""
    c = grid(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("cells"), F.min(F.col("row") * 64 + F.col("col")).alias("first"))
    return c.select("cls", (F.row_number().over(Window.orderBy(F.desc("cells"), "first")) - 1).cast("long").alias("code"), "cells")


@query(f"WITH {GRID} SELECT count(*) FILTER (WHERE value < 150) AS pits, CAST(sum(CASE WHEN value < 150 THEN 0 ELSE value END) AS DOUBLE) AS total, count(*) FILTER (WHERE n IS NULL) AS missing, max(least(500, greatest(50, value))) AS top, CAST(4096 - count(*) AS BIGINT) AS gaps FROM grid")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return grid(spark, sf_dir).agg(F.count_if(v < 150).alias("pits"), F.sum(F.when(v < 150, 0.0).otherwise(v)).alias("total"), F.count_if(F.col("n").isNull()).alias("missing"), F.max(F.least(F.lit(500.0), F.greatest(F.lit(50.0), v))).alias("top"), (F.lit(4096) - F.count("*")).cast("long").alias("gaps"))


@query(f"""WITH {GRID} SELECT row, sha256(string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY col)) AS digest, min(value) AS low, max(value) AS high,
count(*) AS n FROM grid GROUP BY 1""")
def grid_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows packed in order, with range and digest."""
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.col("value").cast("long").cast("string").alias("v")))), lambda c: c["v"]), ",")
    return grid(spark, sf_dir).groupBy("row").agg(F.sha2(cells, 256).alias("digest"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


@query("""WITH f AS (SELECT n_nationkey AS frame, n_nationkey % 3 + 3 AS z, n_nationkey * 7 % 20 AS x0, n_nationkey * 5 % 11 AS y0, count(*) AS n FROM nation
JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
t AS (SELECT frame, z, unnest(range(x0, x0 + 1 + n % 9)) AS x, y0, n FROM f), u AS (SELECT frame, z, x, unnest(range(y0, y0 + 1 + n % 5)) AS y
FROM t), c AS (SELECT s_nationkey % 3 + 3 AS z, s_suppkey % 28 AS x, s_suppkey * 3 % 16 AS y FROM supplier)
SELECT z, x, y, count(DISTINCT frame) AS frames FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.z = u.z AND c.x = u.x AND c.y = u.y) GROUP BY 1, 2, 3""")
def tile_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that cover the frames of a table and that a table of cached tiles lacks; a tile of several frames is one job."""
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("frame")).agg(F.count("*").alias("n"))
    f = table(spark, sf_dir, "nation").select(k.cast("long").alias("frame"), (k % 3 + 3).alias("z"), (k * 7 % 20).alias("x0"), (k * 5 % 11).alias("y0")).join(n, "frame")
    wide = f.withColumn("x", F.explode(F.sequence("x0", (F.col("x0") + F.col("n") % 9).cast(f.schema["x0"].dataType))))
    every = wide.withColumn("y", F.explode(F.sequence("y0", (F.col("y0") + F.col("n") % 5).cast(f.schema["y0"].dataType))))
    cached = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 3 + 3).alias("z"), (s % 28).alias("x"), (s * 3 % 16).alias("y"))
    return every.join(cached, ["z", "x", "y"], "left_anti").groupBy("z", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).agg(F.countDistinct("frame").alias("frames"))
