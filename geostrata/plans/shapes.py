"""Queries of grid sizes, turned vectors, height codes, samples around the globe, and small or young polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import expressions as E
from geostrata.operators import raster
from geostrata.plans.bindings import CORNERS, GRID, edges, grid
from geostrata.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Extents by customer: metres, then degrees.
EXTENTS = """e AS (SELECT c_custkey, CAST(500000 + k * 37 % 1000 AS DOUBLE) AS x0, CAST(500300 + k * 37 % 1000 + k * 53 % 9000 AS DOUBLE) AS x1,
CAST(4000000 AS DOUBLE) AS y0, CAST(4000450 + k * 71 % 7000 AS DOUBLE) AS y1,
CAST(k % 80 AS DOUBLE) / 4 - 120 AS w, CAST(k % 80 + 3 + k % 7 AS DOUBLE) / 4 - 120 AS e, CAST(k % 50 AS DOUBLE) / 4 + 30 AS s,
CAST(k % 50 + 2 + k % 9 AS DOUBLE) / 4 + 30 AS n FROM (SELECT c_custkey, c_custkey AS k FROM customer) t)"""


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    east, degrees = k * 37 % 1000, lambda v, base: v.cast("double") / 4 + base
    return table(spark, sf_dir, "customer").select(
        k,
        (east + 500000).cast("double").alias("x0"),
        (east + 500300 + k * 53 % 9000).cast("double").alias("x1"),
        F.lit(4000000.0).alias("y0"),
        (k * 71 % 7000 + 4000450).cast("double").alias("y1"),
        degrees(k % 80, -120).alias("w"),
        degrees(k % 80 + 3 + k % 7, -120).alias("e"),
        degrees(k % 50, 30).alias("s"),
        degrees(k % 50 + 2 + k % 9, 30).alias("n"),
    )


@query(f"""WITH {EXTENTS}, l AS (SELECT *, greatest(30.0::DOUBLE, greatest(x1 - x0, y1 - y0) / 199) AS step, greatest(x1 - x0, y1 - y0) / 63 AS step2,
round_even((x1 - x0) / 30, 0) AS w30, round_even((y1 - y0) / 30, 0) AS h30 FROM e)
SELECT c_custkey, CAST(round_even((x1 - x0) / step, 0) AS INT) + 1 AS bounded_cols, CAST(round_even((y1 - y0) / step, 0) AS INT) + 1 AS bounded_rows,
CAST(round_even((x1 - x0) / step2, 0) AS INT) + 1 AS long_cols, CAST(round_even((y1 - y0) / step2, 0) AS INT) + 1 AS long_rows,
CAST(w30 AS INT) AS request_cols, CAST(h30 AS INT) AS request_rows, CAST(CASE WHEN w30 >= h30 THEN 96 ELSE greatest(2,
round_even(96 * w30 / h30, 0)) END AS INT) AS view_cols, CAST(CASE WHEN w30 >= h30 THEN greatest(2,
round_even(96 * h30 / w30, 0)) ELSE 96 END AS INT) AS view_rows,
CAST(round_even(512 * (n - s) / ((e - w) * cos(radians((s + n) / 2))), 0) AS INT) AS frame_rows,
CAST(trunc((50 - n) * 24) AS INT) - 1 AS window_row, CAST(trunc((w + 125) * 24) AS INT) - 1 AS window_col,
CAST(trunc((50 - s) * 24) AS INT) - CAST(trunc((50 - n) * 24) AS INT) + 3 AS window_rows,
CAST(trunc((e + 125) * 24) AS INT) - CAST(trunc((w + 125) * 24) AS INT) + 3 AS window_cols,
greatest(w, -115) AS clip_w, greatest(s, 33) AS clip_s, least(e, -105) AS clip_e, least(n, 40) AS clip_n, CAST(floor(w) - 60 AS BIGINT) AS pad_w,
CAST(ceil(n) + 60 AS BIGINT) AS pad_n FROM l""")
def grid_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of grids over extents by each rule: bounded or stated points, requests and views, square cells, windows of a degree grid, clipped and padded boxes."""
    box, deg = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(c) for c in ("w", "s", "e", "n")]
    named = {
        ("bounded_cols", "bounded_rows"): E.lattice_shape(*box, cell=30.0, most=200),
        ("long_cols", "long_rows"): E.lattice_shape(*box, longest=64),
        ("request_cols", "request_rows", "view_cols", "view_rows"): E.request_shape(*box, 30.0, 96),
        ("frame_rows",): (E.frame_rows(*deg, 512),),
        ("window_row", "window_col", "window_rows", "window_cols"): E.degree_window(*deg, -125.0, 50.0, 1 / 24),
        ("clip_w", "clip_s", "clip_e", "clip_n"): E.clip_box(deg, [F.lit(float(v)) for v in (-115, 33, -105, 40)]),
    }
    west, _, _, north = E.padded(*deg, 60)
    return extents(spark, sf_dir).select("c_custkey", *[c.alias(n) for names, columns in named.items() for n, c in zip(names, columns, strict=True)], west.alias("pad_w"), north.alias("pad_n"))


@query("""WITH p AS (SELECT c_custkey, radians(CAST(c_custkey * 7919 % 170 AS DOUBLE) - 85) AS lat,
radians(CAST(c_custkey * 104729 % 360 AS DOUBLE) - 180) AS lon, radians(CAST(c_custkey % 120 AS DOUBLE) - 60) AS plat,
radians(CAST(c_custkey % 300 AS DOUBLE) - 150) AS plon, radians(CAST(c_custkey % 90 AS DOUBLE)) AS a FROM customer),
v AS (SELECT *, cos(lat) * cos(lon) AS x, cos(lat) * sin(lon) AS y, sin(lat) AS z, cos(plat) * cos(plon) AS i, cos(plat) * sin(plon) AS j,
sin(plat) AS k FROM p), d AS (SELECT *, (x * i + y * j + z * k) * (1 - cos(a)) AS along FROM v)
SELECT c_custkey, round(x * cos(a) + (j * z - k * y) * sin(a) + i * along, 7) + 0.0 AS x,
round(y * cos(a) + (k * x - i * z) * sin(a) + j * along, 7) + 0.0 AS y, round(z * cos(a) + (i * y - j * x) * sin(a) + k * along, 7) + 0.0 AS z FROM d""")
def turned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the sphere as vectors, turned about poles by quaternions; the SQL turns them by axis and angle."""
    k = F.col("c_custkey")
    degrees = lambda v, base: v.cast("double") + base
    v = E.unit_vector(degrees(k * 7919 % 170, -85), degrees(k * 104729 % 360, -180))
    q = E.quaternion_of_pole(degrees(k % 120, -60), degrees(k % 300, -150), degrees(k % 90, 0))
    p = table(spark, sf_dir, "customer").select(k, v.alias("v"), q.alias("q"))
    r = p.select(k, E.rotated(F.col("q"), F.col("v")).alias("r"))
    return r.select(k, *[(F.round(f"r.{c}", 7) + 0.0).alias(c) for c in "xyz"])


@query("""WITH h AS (SELECT DISTINCT CAST(l_orderkey * 31 % 24001 - 12000 AS DOUBLE) AS h FROM lineitem), c AS (SELECT h, CAST(CASE
WHEN h >= 0 THEN 128 + round_even(127 * sqrt(least(h, 8848.0::DOUBLE) / 8848), 0) ELSE 127 - round_even(127 * sqrt(least(-h, 11000.0::DOUBLE) / 11000), 0) END AS INT) AS code
FROM h)
SELECT code, count(*) AS n, min(h) AS lowest, max(h) AS highest, round(CASE
WHEN code >= 128 THEN ((code - 128) / 127.0::DOUBLE) * ((code - 128) / 127.0::DOUBLE) * 8848 ELSE -((127 - code) / 127.0::DOUBLE) * ((127 - code) / 127.0::DOUBLE) * 11000 END, 4) + 0.0 AS metres
FROM c GROUP BY 1""")
def height_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights and depths as one byte on square-root scales, and the metres that each byte stands for."""
    h = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 31 % 24001 - 12000).cast("double").alias("h")).distinct()
    c = h.select("h", E.height_byte(F.col("h")).alias("code")).groupBy("code").agg(F.count("*").alias("n"), F.min("h").alias("lowest"), F.max("h").alias("highest"))
    return c.select("*", (F.round(E.byte_height(F.col("code")), 4) + 0.0).alias("metres"))


@query(f"""WITH {GRID}, p AS (SELECT c_custkey, CAST(c_custkey * 7919 % 900 AS DOUBLE) / 8 - 20 AS x, CAST(c_custkey * 104729 % 700 AS DOUBLE) / 8 - 10 AS y
FROM customer),
q AS (SELECT *, least(greatest(y, 0), 62.999::DOUBLE) AS v, CAST(floor(x) AS BIGINT) AS c,
CAST(floor(least(greatest(y, 0), 62.999::DOUBLE)) AS BIGINT) AS r FROM p),
m AS (SELECT *, (c % 64 + 64) % 64 AS c0, ((c + 1) % 64 + 64) % 64 AS c1 FROM q)
SELECT c_custkey, round(a.value * (1 - (x - m.c)) * (1 - (v - r)) + b.value * (x - m.c) * (1 - (v - r)) + d.value * (1 - (x - m.c)) * (v - r) + e.value * (x - m.c) * (v - r), 8) AS around,
f.value AS near
FROM m LEFT JOIN grid a ON a.row = r AND a.col = c0 LEFT JOIN grid b ON b.row = r AND b.col = c1 LEFT JOIN grid d ON d.row = r + 1 AND d.col = c0 LEFT
JOIN grid e ON e.row = r + 1 AND e.col = c1
LEFT JOIN grid f ON f.row = CAST(floor(y + 0.5) AS BIGINT) AND f.col = CAST(floor(x + 0.5) AS BIGINT)""")
def globe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid sampled around the globe, columns joined at the ends and rows clamped, and by the nearest cell."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k, ((k * 7919 % 900).cast("double") / 8 - 20).alias("x"), ((k * 104729 % 700).cast("double") / 8 - 10).alias("y"))
    g = grid(spark, sf_dir).select("row", "col", "value")
    around = raster.bilinear_round(p, g, 64, 64).withColumnRenamed("value", "around")
    return raster.nearest(around, g).select(k, F.round("around", 8).alias("around"), F.col("value").alias("near"))


@query(f"""WITH {CORNERS} SELECT poly, CAST(poly % 9 * 10 AS INT) AS from_age, CAST(greatest(poly % 7 * 9 - 20, 0) AS INT) AS to_age, CAST(CASE
WHEN diamond THEN 50 ELSE w * h END AS DOUBLE) AS area FROM corners WHERE poly % 7 * 9 - 20 <= 30 AND CASE WHEN diamond THEN 50 ELSE w * h END >= 63""")
def clipped_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer rings with ages clipped to the present, without those that end before the oldest age and specks under a least area."""
    x, y, x2, y2 = (F.col(c) for c in ("x", "y", "x2", "y2"))
    rings = edges(spark, sf_dir).where("ring = 0").groupBy("poly").agg((F.abs(F.sum(x * y2 - x2 * y)) / 2.0).alias("area"))
    k = F.col("poly")
    aged = rings.select("poly", (k % 9 * 10).cast("int").alias("from_age"), F.greatest(k % 7 * 9 - 20, F.lit(0)).cast("int").alias("to_age"), "area")
    return aged.where("to_age <= 30 and area >= 63")
