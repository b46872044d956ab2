"""Queries of basins, crossings and intervals that go by a grid of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import expressions as E
from geostrata.functions.fields import normal, on_lattice, value_noise
from geostrata.operators import spatial
from geostrata.operators.flood import flood, pools
from geostrata.plans.bindings import GRID, grid
from geostrata.plans.series import UTM_SQL
from geostrata.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Smallest labels spread along edges until none changes; a row of the recursion is replaced by its better one.
SPREAD = """both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, label) USING KEY (node) AS (
  SELECT id AS node, id AS label FROM cells
  UNION SELECT b.a, min(t.label) FROM reach t JOIN both_ b ON b.b = t.node JOIN recurring.reach r ON r.node = b.a WHERE t.label < r.label GROUP BY 1)"""


@query(f"""WITH RECURSIVE {GRID}, cells AS (SELECT row * 64 + col AS id, row, col FROM grid WHERE value < 330),
e AS (SELECT x.id AS a, y.id AS b FROM cells x JOIN cells y ON (y.row = x.row AND y.col = x.col + 1) OR (y.col = x.col
AND y.row = x.row + 1)), {SPREAD}
SELECT label, count(*) AS cells FROM reach GROUP BY 1""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of low cells, by neighbours of four; a pool's label is its first cell."""
    low = grid(spark, sf_dir).where("value < 330").select("row", "col")
    label = F.shiftright("pool", 32) * 64 + F.col("pool") % (1 << 32)
    return pools(low, 16).groupBy(label.alias("label")).agg(F.count("*").alias("cells"))


#: A map of 250 columns with a cell for each order: it grows with the table.
MAP = "cells AS (SELECT o_orderkey AS id, o_orderkey // 250 AS row, o_orderkey % 250 AS col FROM orders WHERE o_totalprice < 280000)"


@query(f"""WITH RECURSIVE {MAP}, e AS (SELECT x.id AS a, y.id AS b FROM cells x JOIN cells y ON (y.id = x.id + 1
AND y.row = x.row) OR y.id = x.id + 250), {SPREAD},
n AS (SELECT label, count(*) AS cells, min(CASE WHEN col = 0 THEN 1 WHEN col = 125 AND row % 2 = 0 THEN 2 END) AS basin FROM reach
JOIN cells ON id = node GROUP BY 1)
SELECT row, CAST(coalesce(basin, CASE WHEN n.cells > 60 THEN 3 ELSE 0 END) AS INT) AS basin, count(*) AS cells FROM reach JOIN n USING (label)
JOIN cells ON id = node GROUP BY 1, 2""")
def flood_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each row of the map by basin: filled from the western edge, from seeds amid the map, other large pools, and small ones."""
    k = F.col("o_orderkey")
    cells = table(spark, sf_dir, "orders").where("o_totalprice < 280000").select(F.floor(k / 250).alias("row"), (k % 250).alias("col"))
    edge = cells.where("col = 0").withColumn("basin", F.lit(1))
    amid = cells.where("col = 125 and row % 2 = 0").withColumn("basin", F.lit(2))
    return flood(cells, edge.unionByName(amid), least=60).groupBy("row", "basin").agg(F.count("*").alias("cells"))


@query("""WITH s AS (SELECT l_orderkey AS x, l_partkey % 97 AS y, l_orderkey + l_partkey * 7 % 41 - 20 AS x2, l_suppkey * 11 % 97 AS y2 FROM lineitem),
q AS (SELECT c_custkey AS sid, c_custkey * 10 AS sx, 0 AS sy, c_custkey * 10 + c_custkey % 35 AS sx2, 96 AS sy2 FROM customer),
p AS (SELECT *, CAST((x2 - x) * (sy2 - sy) - (y2 - y) * (sx2 - sx) AS DOUBLE) AS d FROM s JOIN q ON greatest(x, x2) >= sx AND least(x, x2) <= sx2),
t AS (SELECT *, ((sx - x) * (sy2 - sy) - (sy - y) * (sx2 - sx)) / d AS t, ((sx - x) * (y2 - y) - (sy - y) * (x2 - x)) / d AS s FROM p WHERE d <> 0)
SELECT sid, count(*) AS crossings, round(min(s), 6) + 0.0 AS first_at, round(max(s), 6) + 0.0 AS last_at FROM t WHERE t >= 0 AND t <= 1 AND s >= 0
AND s <= 1 GROUP BY 1""")
def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the segments of a map cross its section lines: a spatial join, then both places by solving for them."""
    i, p = F.col("l_orderkey"), F.col("l_partkey")
    s = table(spark, sf_dir, "lineitem").select(i.alias("x"), (p % 97).alias("y"), (i + p * 7 % 41 - 20).alias("x2"), (F.col("l_suppkey") * 11 % 97).alias("y2"))
    c = F.col("c_custkey")
    ends = [(c * 10).alias("sx"), F.lit(0).alias("sy"), (c * 10 + c % 35).alias("sx2"), F.lit(96).alias("sy2")]
    hit = spatial.crossing_pairs(s, table(spark, sf_dir, "customer").select(c.alias("sid"), *ends), 48.0)
    places = [(F.round(g("s"), 6) + 0.0).alias(n) for g, n in ((F.min, "first_at"), (F.max, "last_at"))]
    return hit.groupBy("sid").agg(F.count("*").alias("crossings"), *places)


#: Corners of the cells of a 64th of a degree around each point, projected by the exact formula.
LATTICE = UTM_SQL.replace("p AS (SELECT c_custkey, 36", "pts AS (SELECT c_custkey, 36").replace(
    "FROM customer)", "FROM customer),\np AS (SELECT c_custkey * 4 + k AS c_custkey, (floor(lat * 64) + k // 2) / 64 AS lat, (floor(lon * 64) + k % 2) / 64 AS lon FROM pts, range(4) r(k))"
)


@query(f"""WITH {LATTICE}, w AS (SELECT c_custkey, k, CASE WHEN k // 2 = 1 THEN lat * 64 - floor(lat * 64) ELSE 1 - (lat * 64 - floor(lat * 64)) END * CASE
WHEN k % 2 = 1 THEN lon * 64 - floor(lon * 64) ELSE 1 - (lon * 64 - floor(lon * 64)) END AS share FROM pts, range(4) r(k))
SELECT w.c_custkey, round(sum(share * easting), 2) AS easting, round(sum(share * northing), 2) AS northing, true AS close FROM w
JOIN utm ON utm.c_custkey = w.c_custkey * 4 + k GROUP BY 1""")
def lattice_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points projected by way of a lattice, and whether each is within 10 cm of its exact place."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k, (36 + (k * 7919 % 1000) / 250.0).alias("lat"), (-124 + (k * 104729 % 1000) / 250.0).alias("lon"))
    near = on_lattice(p, "lat", "lon", 1 / 64, lambda lat, lon: E.utm(lat, lon, 10))
    x, y = E.utm(F.col("lat"), F.col("lon"), 10)
    return near.select(k, F.round("px", 2).alias("easting"), F.round("py", 2).alias("northing"), (F.hypot(F.col("px") - x, F.col("py") - y) < 0.1).alias("close"))


def _drawn_sql(seed: int, *counters: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(',', '{seed}', {', '.join(f'CAST({c} AS BIGINT)' for c in counters)})), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)"


@query(f"""WITH c AS (SELECT o_orderkey, o_orderkey // 250 AS row, o_orderkey % 250 AS col FROM orders), n AS (SELECT *, row / 12.0::DOUBLE - row // 12 AS y,
col / 12.0::DOUBLE - col // 12 AS x, row // 12 AS i, col // 12 AS j FROM c),
s AS (SELECT *, y * y * (3 - 2 * y) AS t, x * x * (3 - 2 * x) AS u FROM n)
SELECT o_orderkey, round((1 - t) * ((1 - u) * {_drawn_sql(7, 'i', 'j')} + u * {_drawn_sql(7, 'i', 'j + 1')}) + t * ((1 - u) * {_drawn_sql(7, 'i + 1', 'j')} + u * {_drawn_sql(7, 'i + 1', 'j + 1')}), 6) AS smooth,
round(sqrt(-2 * ln({_drawn_sql(11, 'row', 'col', '0')})) * cos(2 * pi() * {_drawn_sql(11, 'row', 'col', '1')}), 6) + 0.0 AS bell FROM s""")
def random_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smooth and normal noise of each cell of the map, by seed and place alone."""
    k = F.col("o_orderkey")
    row, col = F.floor(k / 250), k % 250
    return table(spark, sf_dir, "orders").select(k, F.round(value_noise(7, row, col, 12.0), 6).alias("smooth"), (F.round(normal(11, row, col), 6) + 0.0).alias("bell"))
