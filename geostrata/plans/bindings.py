"""Geodata shapes over the standard tables, in Spark and, for the oracles, in SQL with the same integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.session import table

SIZE = 64

#: Grid: 64 x 64 cells of lineitem with summed quantity, rows and a class.
GRID = "grid AS (SELECT l_suppkey % 64 AS row, l_partkey % 64 AS col, CAST(sum(l_quantity) AS DOUBLE) AS value, count(*) AS n, max(l_partkey) % 7 AS cls FROM lineitem GROUP BY 1, 2)"
#: One ring for each nation: a rectangle, or a diamond for odd keys; keys divisible by 5 have a square hole.
CORNERS = """corners AS (
  SELECT n_nationkey AS poly, 0 AS ring, x0, y0, CASE WHEN n_nationkey % 2 = 1 THEN x0 + 5 ELSE x0 + w END AS x1,
    n_nationkey % 2 = 1 AS diamond, w, h FROM (SELECT n_nationkey, (n_nationkey % 5) * 12 + 1 AS x0,
CAST(floor(n_nationkey / 5) AS INT) * 12 + 1 AS y0, 8 + n_nationkey % 3 AS w, 7 + n_nationkey % 4 AS h FROM nation) t)"""
EDGES = CORNERS + """, edges AS (
  SELECT poly, ring, 0 AS seq, x0 AS x, y0 AS y, x0 + w AS x2, y0 AS y2 FROM corners WHERE NOT diamond
  UNION ALL SELECT poly, ring, 1, x0 + w, y0, x0 + w, y0 + h FROM corners WHERE NOT diamond
  UNION ALL SELECT poly, ring, 2, x0 + w, y0 + h, x0, y0 + h FROM corners WHERE NOT diamond
  UNION ALL SELECT poly, ring, 3, x0, y0 + h, x0, y0 FROM corners WHERE NOT diamond
  UNION ALL SELECT poly, ring, 0, x0 + 5, y0, x0 + 10, y0 + 5 FROM corners WHERE diamond
  UNION ALL SELECT poly, ring, 1, x0 + 10, y0 + 5, x0 + 5, y0 + 10 FROM corners WHERE diamond
  UNION ALL SELECT poly, ring, 2, x0 + 5, y0 + 10, x0, y0 + 5 FROM corners WHERE diamond
  UNION ALL SELECT poly, ring, 3, x0, y0 + 5, x0 + 5, y0 FROM corners WHERE diamond
  UNION ALL SELECT poly, 1, 0, x0 + 2, y0 + 2, x0 + 5, y0 + 2 FROM corners WHERE poly % 5 = 0
  UNION ALL SELECT poly, 1, 1, x0 + 5, y0 + 2, x0 + 5, y0 + 5 FROM corners WHERE poly % 5 = 0
  UNION ALL SELECT poly, 1, 2, x0 + 5, y0 + 5, x0 + 2, y0 + 5 FROM corners WHERE poly % 5 = 0
  UNION ALL SELECT poly, 1, 3, x0 + 2, y0 + 5, x0 + 2, y0 + 2 FROM corners WHERE poly % 5 = 0)"""
#: Cells inside each polygon, decided cell by cell with the crossing number: independent of the scanline fill.
INSIDE = """cells AS (SELECT r.range AS row, c.range AS col FROM range(64) r, range(64) c),
mask AS (SELECT poly, row, col FROM cells JOIN edges ON y <> y2 AND row + 0.5 >= least(y, y2) AND row + 0.5 < greatest(y, y2)
  AND x + (row + 0.5 - y) * (x2 - x) / (y2 - y) <= col + 0.5 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col")).agg(F.sum("l_quantity").cast("double").alias("value"), F.count("*").alias("n"), (F.max("l_partkey") % 7).alias("cls"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(k.alias("poly"), ((k % 5) * 12 + 1).alias("x0"), (F.floor(k / 5).cast("int") * 12 + 1).alias("y0"), (8 + k % 3).alias("w"), (7 + k % 4).alias("h"))
    square = "array(struct(x0 as x, y0 as y), struct(x0 + w as x, y0 as y), struct(x0 + w as x, y0 + h as y), struct(x0 as x, y0 + h as y))"
    diamond = "array(struct(x0 + 5 as x, y0 as y), struct(x0 + 10 as x, y0 + 5 as y), struct(x0 + 5 as x, y0 + 10 as y), struct(x0 as x, y0 + 5 as y))"
    hole = "array(struct(x0 + 2 as x, y0 + 2 as y), struct(x0 + 5 as x, y0 + 2 as y), struct(x0 + 5 as x, y0 + 5 as y), struct(x0 + 2 as x, y0 + 5 as y))"
    rings = n.select("poly", F.expr(f"if(poly % 2 = 1, {diamond}, {square})").alias("outer"), F.expr(f"if(poly % 5 = 0, {hole}, null)").alias("hole"))
    long = rings.select("poly", F.posexplode(F.array("outer", "hole")).alias("ring", "pts")).where("pts is not null")
    return long.select("poly", "ring", F.posexplode("pts").alias("seq", "p"), "pts").select("poly", "ring", "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.expr("pts[(seq + 1) % size(pts)].x").alias("x2"), F.expr("pts[(seq + 1) % size(pts)].y").alias("y2"))


#: Lines: the rows of an order, ordered by all that tells them apart; x and y are integers.
POINTS = """pts AS (SELECT l_orderkey AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
l_shipdate, l_discount, l_tax, l_quantity) - 1 AS seq,
  l_partkey % 1000 AS x, l_suppkey * 7 % 1000 AS y FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), (F.row_number().over(w) - 1).cast("long").alias("seq"), (F.col("l_partkey") % 1000).alias("x"), (F.col("l_suppkey") * 7 % 1000).alias("y"))
