"""Queries of layers' roles and links, frames and windows, segment crossings, shading, packed cubes and weekly counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.functions import expressions as E
from geostrata.functions.documents import harvest
from geostrata.operators import raster
from geostrata.plans.bindings import EDGES, GRID, edges, grid
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


#: Roles that a layer's name may begin with, and the geometry types that each may have.
ROLES = {"boundary": ("Polygon", "MultiPolygon"), "line": ("LineString", "MultiLineString"), "site": ("Point",)}
_LAYER = (
    """{"name": "%s: Layer %d", "source": {"url": "https://a.example/%d", "tiles": ["https://t.example/%d {z}", "https://a.example/%d"]}, """
    """"geometry": {"type": "%s", "parts": [{"note": "https://geometry.example/%d", "at": {"x": 1}}, "}"]}}"""
)


def role_of(name: Column) -> tuple[Column, Column]:
    """Role and title of a layer's name, ``role: title``; without a known role the whole name is the title."""
    role = F.lower(F.regexp_extract(name, r"^\s*([A-Za-z]+)\s*:", 1))
    known = role.isin(*ROLES)
    return F.when(known, role), F.when(known, F.trim(F.regexp_replace(name, r"^[^:]*:", ""))).otherwise(name)


@query("""WITH l AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'boundary' WHEN 1 THEN 'Line' WHEN 2 THEN 'site' ELSE 'Note' END AS prefix,
CASE p_partkey % 3 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'Point' ELSE 'LineString' END AS kind FROM part)
SELECT p_partkey, CASE WHEN prefix <> 'Note' THEN lower(prefix) END AS role, CASE
WHEN prefix = 'Note' THEN 'Note: Layer ' || p_partkey ELSE 'Layer ' || p_partkey END AS title,
CASE WHEN p_partkey % 9 = p_partkey % 7 THEN 'https://a.example/' || p_partkey % 9 || ' https://t.example/' || p_partkey % 5 ELSE 'https://a.example/' || p_partkey % 9 || ' https://t.example/' || p_partkey % 5 || ' https://a.example/' || p_partkey % 7 END AS urls,
(prefix, kind) IN (('boundary', 'Polygon'), ('Line', 'LineString'), ('site', 'Point')) AS allowed FROM l""")
def layer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of layers: addresses harvested outside of geometry, role and title of the name, and whether the role may have this geometry."""
    k = F.col("p_partkey")
    prefix = F.when(k % 4 == 0, "boundary").when(k % 4 == 1, "Line").when(k % 4 == 2, "site").otherwise("Note")
    kind = F.when(k % 3 == 0, "Polygon").when(k % 3 == 1, "Point").otherwise("LineString")
    doc = F.format_string(_LAYER, prefix, k, k % 9, k % 5, k % 7, kind, k)
    d = table(spark, sf_dir, "part").select(k, doc.alias("doc"))
    d = d.select(k, "doc", F.from_json("doc", "name string, geometry struct<type:string>").alias("j"))
    role, title = role_of(F.col("j.name"))
    allowed = F.element_at(F.create_map(*[x for r, kinds in ROLES.items() for x in (F.lit(r), F.array(*map(F.lit, kinds)))]), F.coalesce(role, F.lit("none")))
    return d.select(k, role.alias("role"), title.alias("title"), F.array_join(harvest(F.col("doc")), " ").alias("urls"), F.coalesce(F.array_contains(allowed, F.col("j.geometry.type")), F.lit(False)).alias("allowed"))


@query(f"""WITH {UTM_SQL}, f AS (SELECT c_nationkey AS frame, min(easting) AS x0, max(easting) AS x1, min(northing) AS y0, max(northing) AS y1, min(lon) AS w,
max(lon) AS e, min(lat) AS s, max(lat) AS n FROM utm JOIN customer USING (c_custkey) GROUP BY 1)
SELECT frame, CASE WHEN frame % 3 = 0 THEN NULL ELSE round(w, 1) - 0.1 <= w END AS west_holds, round(CASE
WHEN frame % 3 = 0 THEN w - 0.05 END, 4) AS planned_west, round(CASE WHEN frame % 3 = 0 THEN n + 0.05 END, 4) AS planned_north,
CAST(ceil((x1 - x0) / 1000) AS INT) AS cols, CAST(ceil((y1 - y0) / 1000) AS INT) AS rows FROM f""")
def frame_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of each frame in degrees: from its projected corners where it is mapped, else from its points with padding; and its grid at a cell of 1 km."""
    k = F.col("c_custkey")
    lat, lon = 36 + (k * 7919 % 1000) / 250.0, -124 + (k * 104729 % 1000) / 250.0
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("frame"), lat.alias("lat"), lon.alias("lon"))
    east, north = E.utm(F.col("lat"), F.col("lon"), 10)
    f = p.select("*", east.alias("x"), north.alias("y")).groupBy("frame").agg(*[g(c).alias(f"{c}{i}") for c in ("x", "y", "lon", "lat") for i, g in enumerate((F.min, F.max))])
    corners = [E.geographic(F.col(f"x{i}"), F.col(f"y{j}"), 10)[1] for i in (0, 1) for j in (0, 1)]
    planned = F.col("frame") % 3 == 0
    return f.select(
        "frame",
        F.when(~planned, F.least(*corners) <= F.col("lon0") + 0.15).alias("west_holds"),
        F.round(F.when(planned, F.col("lon0") - 0.05), 4).alias("planned_west"),
        F.round(F.when(planned, F.col("lat1") + 0.05), 4).alias("planned_north"),
        *[c.alias(n) for n, c in zip(("cols", "rows"), E.grid_shape(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 1000.0), strict=True)],
    )


@query(f"""WITH {GRID}, days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), w AS (SELECT row - 2 AS row, col - 20 AS col, value FROM grid
WHERE row BETWEEN 2 AND 9 AND col BETWEEN 20 AND 43)
SELECT day, count(*) AS cells, round(sum(value), 4) AS total, CAST(min(row) AS BIGINT) AS row0, CAST(max(col) AS BIGINT) AS col1 FROM days, w
GROUP BY 1""")
def pinned_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window, stated once as a row of grid metadata, cut from the grid for every day."""
    frame = spark.createDataFrame([(2, 20, 8, 24)], "row0 long, col0 long, rows long, cols long")
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    cut = raster.window(grid(spark, sf_dir).select("row", "col", "value"), frame)
    sums = cut.agg(F.count("*").alias("cells"), F.sum("value").alias("total"), F.min("row").alias("row0"), F.max("col").alias("col1"))
    return days.join(F.broadcast(sums)).select("day", "cells", F.round("total", 4).alias("total"), "row0", "col1")  # one row


@query(f"""WITH {GRID}, g AS (SELECT row, col, (coalesce(lead(value) OVER (PARTITION BY row ORDER BY col), value) - coalesce(lag(value) OVER (PARTITION BY row
ORDER BY col), value)) / 20.0 AS gx,
(coalesce(lead(value) OVER (PARTITION BY col ORDER BY row), value) - coalesce(lag(value) OVER (PARTITION BY col ORDER BY row), value)) / 20.0 AS gy
FROM grid)
SELECT row, col, round(greatest(0.0, (-gx * cos(radians(45.0)) * sin(radians(315.0)) + gy * cos(radians(45.0)) * cos(radians(315.0)) + sin(radians(45.0))) / sqrt(1 + gx * gx + gy * gy)), 6) AS shade
FROM g""")
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light from the north-west at 45 degrees on the slopes of a grid; rows run south."""
    return raster.hillshade(grid(spark, sf_dir).select("row", "col", "value"), 10.0, 315.0, 45.0).select("row", "col", F.round("shade", 6).alias("shade"))


@query(f"""WITH {GRID}, n AS (SELECT cls, count(*) AS cells, min(row * 64 + col) AS first_seen FROM grid GROUP BY 1), r AS (SELECT cls,
row_number() OVER (ORDER BY cells DESC, first_seen) - 1 AS code FROM n) SELECT row, col, code FROM grid JOIN r USING (cls)""")
def rank_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of classes renumbered by area, largest first; the window sees one row a class."""
    g = grid(spark, sf_dir).select("row", "col", "cls")
    n = g.groupBy("cls").agg(F.count("*").alias("cells"), F.min(F.col("row") * 64 + F.col("col")).alias("first_seen"))
    r = n.select("cls", (F.row_number().over(Window.orderBy(F.desc("cells"), "first_seen")) - 1).cast("long").alias("code"))
    return g.join(r, "cls").select("row", "col", "code")


@query("""WITH e AS (SELECT event_type, CAST(year(ts) AS INT) AS y, CAST(dayofyear(ts) - 1 AS INT) AS d, CAST(round_even(max(value) * 10, 0) AS BIGINT) AS v
FROM events GROUP BY 1, 2, 3),
a AS (SELECT x.event_type, x.y, n.range AS d, coalesce(e.v, -32768) AS v FROM (SELECT DISTINCT event_type, y FROM e) x CROSS JOIN range(366) n LEFT
JOIN e ON e.event_type = x.event_type AND e.y = x.y AND e.d = n.range WHERE n.range < CASE WHEN x.y % 4 = 0
AND (x.y % 100 <> 0 OR x.y % 400 = 0) THEN 366 ELSE 365 END)
SELECT event_type, y, CAST(count(*) AS INT) AS days, CAST(min(d) FILTER (WHERE v <> -32768) AS INT) AS first_day, CAST(2 * count(*) AS INT) AS bytes,
sha256(string_agg(printf('%02x%02x', v & 255, (v >> 8) & 255), '' ORDER BY d)) AS digest FROM a GROUP BY 1, 2""")
def year_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed years of daily values: little-endian 16-bit tenths with a no-data code, and the index entry of each."""
    packed = E.pack_year("days", "y")
    e = table(spark, sf_dir, "events").groupBy("event_type", F.year("ts").alias("y"), (F.dayofyear("ts") - 1).alias("d")).agg(F.bround(F.max("value") * 10).cast("int").alias("v"))
    c = e.groupBy("event_type", "y").agg(F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("days"), F.min("d").alias("first_day"))
    c = c.select("event_type", "y", "first_day", packed.alias("packed"))
    return c.select("event_type", "y", (F.octet_length("packed") / 2).cast("int").alias("days"), "first_day", F.octet_length("packed").alias("bytes"), F.sha2(F.lower(F.hex("packed")), 256).alias("digest"))


@query("""WITH v AS (SELECT line, seq, v - coalesce(lag(v) OVER (PARTITION BY line ORDER BY seq), 0) AS d FROM (SELECT l_orderkey AS line,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_partkey % 30000 AS v FROM lineitem) t)
SELECT line, string_agg(printf('%02x', d & 255), '' ORDER BY seq) || string_agg(printf('%02x', (d >> 8) & 255), '' ORDER BY seq) AS planes FROM v
GROUP BY 1""")
def byte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences as differences of 16 bits, all low bytes before all high bytes."""
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    seqs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line")).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    values = F.transform("rows", lambda r: (r["l_partkey"] % 30000).cast("int"))
    return seqs.select("line", values.alias("v")).select("line", F.lower(F.hex(E.to_planes("v"))).alias("planes"))


@query("""WITH k AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, value FROM events) SELECT week, count(*) AS n,
count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
count(*) FILTER (WHERE value > 90) AS high FROM k GROUP BY 1""")
def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each week by condition, in one pass."""
    e = table(spark, sf_dir, "events").withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    kind = F.col("event_type")
    return e.groupBy("week").agg(F.count("*").alias("n"), F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "purchase").alias("purchases"), F.count_if(F.col("value") > 90).alias("high"))


@query(f"""WITH {EDGES}, hit AS (SELECT p.id, e.poly FROM (SELECT c_custkey AS id, (c_custkey * 7919 % 800 + 0.25) / 10 - 5 AS px,
(c_custkey * 104729 % 800 + 0.25) / 10 - 5 AS py FROM customer) p JOIN edges e ON (e.y > p.py) <> (e.y2 > p.py)
AND p.px < (e.x2 - e.x) * (p.py - e.y) / (e.y2 - e.y) + e.x GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT c_custkey, coalesce((SELECT max('unit ' || poly) FROM hit WHERE id = c_custkey), '') AS unit FROM customer""")
def unit_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name of the area at each point; an empty text where there is none."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k, ((k * 7919 % 800 + 0.25) / 10 - 5).alias("px"), ((k * 104729 % 800 + 0.25) / 10 - 5).alias("py")).withColumn("band", F.floor("py"))
    e = edges(spark, sf_dir).where("y <> y2").withColumn("band", F.explode(F.expr("sequence(cast(least(y, y2) as bigint), cast(greatest(y, y2) as bigint))")))
    west = F.col("px") < (F.col("x2") - F.col("x")) * (F.col("py") - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x")
    inside = p.join(e, "band").where(((F.col("y") > F.col("py")) != (F.col("y2") > F.col("py"))) & west).groupBy("c_custkey", "poly").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    named = inside.groupBy("c_custkey").agg(F.max(F.concat(F.lit("unit "), F.col("poly").cast("string"))).alias("unit"))
    return p.select(k).join(named, "c_custkey", "left").select(k, F.coalesce("unit", F.lit("")).alias("unit"))


@query(f"""WITH f AS (SELECT n_nationkey AS frame, n_nationkey * 13 % 300 - 150.0::DOUBLE AS w, n_nationkey * 7 % 120 - 60.0::DOUBLE AS s FROM nation),
t AS (SELECT frame, range AS k FROM f, range(0, 9)), p AS (SELECT f.frame, w + (k % 3) * 1.5 AS lon, s + (k // 3) * 1.0 AS lat FROM f
JOIN t ON t.frame = f.frame),
x AS (SELECT frame, CAST(floor((lon + 180) / 360 * 128) AS BIGINT) AS tx,
CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / {math.pi!r}) / 2 * 128) AS BIGINT) AS ty FROM p) SELECT frame, count(*) AS samples,
count(DISTINCT tx * 1000 + ty) AS tiles, min(tx) AS tx0, max(tx) AS tx1, min(ty) AS ty0, max(ty) AS ty1 FROM x GROUP BY 1""")
def lonlat_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling points of each frame in degrees and the tiles that cover them, with their bounds."""
    k = F.col("n_nationkey")
    f = table(spark, sf_dir, "nation").select(k.alias("frame"), (k * 13 % 300 - 150.0).alias("w"), (k * 7 % 120 - 60.0).alias("s"))
    p = f.select("frame", "w", "s", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).select("frame", (F.col("w") + F.col("i") % 3 * 1.5).alias("lon"), (F.col("s") + F.floor(F.col("i") / 3) * 1.0).alias("lat"))
    px, py = E.mercator_pixel(F.col("lat"), F.col("lon"), 7, 1)
    x = p.select("frame", F.floor(px).alias("tx"), F.floor(py).alias("ty"))
    return x.groupBy("frame").agg(F.count("*").alias("samples"), F.countDistinct(F.col("tx") * 1000 + F.col("ty")).alias("tiles"), F.min("tx").alias("tx0"), F.max("tx").alias("tx1"), F.min("ty").alias("ty0"), F.max("ty").alias("ty1"))


@query("""SELECT conv_id, bool_or(contains(lower(text), 'the')) AS switched_on, count(*) FILTER (WHERE contains(lower(text), 'the')) AS turns FROM conversations
GROUP BY 1""")
def feature_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A switch that is on where a text says so."""
    on = F.contains(F.lower("text"), F.lit("the"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(on).alias("switched_on"), F.count_if(on).alias("turns"))
