"""Queries over time, the sphere and projections, networks, and batch forms of the streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.functions import expressions as E
from geostrata.operators import graph
from geostrata.operators.relational import asof_backward, top_n
from geostrata.plans.bindings import EDGES, POINTS, edges, grid, points
from geostrata.session import table
from geostrata.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


KEYS = "k AS (SELECT o_custkey AS key, o_orderkey, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS age, o_totalprice AS v FROM orders), k1 AS (SELECT key, age, arg_max(v, o_orderkey) AS v FROM k GROUP BY 1, 2)"


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1995-01-01"))).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", age.alias("age"), F.col("o_totalprice").alias("v")).groupBy("key", "age").agg(F.max_by("v", "o_orderkey").alias("v"))


@query(f"""WITH {KEYS}, q AS (SELECT DISTINCT key, t.range * 300 AS at FROM k1, range(0, 9) t)
SELECT q.key, q.at, round(CASE WHEN b.age IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (q.at - a.age) / CAST(b.age - a.age AS DOUBLE) END + 1e-6, 4) AS value
FROM q
JOIN k1 a ON a.key = q.key AND a.age = (SELECT max(age) FROM k1 x WHERE x.key = q.key AND x.age <= q.at) LEFT JOIN k1 b ON b.key = q.key
AND b.age = (SELECT min(age) FROM k1 x WHERE x.key = q.key AND x.age > q.at)""")
def keyframe_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at given ages between the keyframes around them, by one as-of window; the last value holds."""
    k = keyframes(spark, sf_dir)
    w = Window.partitionBy("key").orderBy("age")
    pairs = k.withColumn("age2", F.lead("age").over(w)).withColumn("v2", F.lead("v").over(w)).select("key", F.col("age").alias("at"), F.col("age").alias("a0"), F.col("v").alias("v0"), F.struct("age2", "v2").alias("nxt"), F.lit(0).alias("tie"))
    q = k.select("key").distinct().withColumn("at", F.explode(F.expr("sequence(0L, 2400L, 300L)")))
    got = asof_backward(q, pairs, ["key"], "at", ["a0", "v0", "nxt"]).where("a0 is not null")
    value = F.when(F.col("nxt.age2").isNull(), F.col("v0")).otherwise(F.col("v0") + (F.col("nxt.v2") - F.col("v0")) * (F.col("at") - F.col("a0")) / (F.col("nxt.age2") - F.col("a0")).cast("double"))
    return got.select("key", "at", F.round(value + 1e-6, 4).alias("value"))


@query("""WITH c AS (SELECT * FROM (VALUES ('recent', 50.0, 0.0), ('middle', 300.0, 50.0), ('old', 900.0, 300.0)) t(name, hi, lo)) SELECT o_orderkey,
coalesce(name, 'recent') AS chapter FROM orders LEFT JOIN c ON o_totalprice / 1000 <= hi AND o_totalprice / 1000 > lo""")
def chapter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval lookup in a dictionary of three rows."""
    c = spark.createDataFrame([("recent", 50.0, 0.0), ("middle", 300.0, 50.0), ("old", 900.0, 300.0)], "name string, hi double, lo double")
    age = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").join(F.broadcast(c), (age <= F.col("hi")) & (age > F.col("lo")), "left").select("o_orderkey", F.coalesce("name", F.lit("recent")).alias("chapter"))


@query("""WITH m AS (SELECT user_id % 24 AS cell, CAST(month(ts) AS INT) AS m, event_type, avg(value) AS t FROM events WHERE event_id % 29 <> 0
GROUP BY 1, 2, 3)
SELECT cell, CASE WHEN count(*) = 5 THEN round(sum(greatest(0.0, t * 9 / 5 + 32 - 50) * 31), 4) END AS gdd FROM m GROUP BY 1""")
def degree_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of warmth above the base times days of the month; null where a series is missing."""
    m = table(spark, sf_dir, "events").where("event_id % 29 <> 0").groupBy((F.col("user_id") % 24).alias("cell"), F.trunc("ts", "month").alias("m"), "event_type").agg(F.avg("value").alias("t"))
    warm = F.greatest(F.lit(0.0), F.col("t") * 9 / 5 + 32 - 50) * F.day(F.last_day("m"))
    return m.groupBy("cell").agg(F.when(F.count("*") == 5, F.round(F.sum(warm), 4)).alias("gdd"))


@query("""WITH d AS (SELECT event_type, CAST(year(ts) AS INT) AS y, count(DISTINCT CAST(ts AS DATE)) AS days, max(CAST(ts AS DATE)) AS last_day, count(*) AS n
FROM events GROUP BY 1, 2) SELECT event_type, y, days, last_day, n, days = 31 AS complete FROM d""")
def day_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("event_type", F.year("ts").alias("y")).agg(F.countDistinct(F.to_date("ts")).alias("days"), F.max(F.to_date("ts")).alias("last_day"), F.count("*").alias("n"))
    return d.withColumn("complete", F.col("days") == 31)


@query("""WITH e AS (SELECT event_type, user_id % 24 AS cell, CAST(ts AS DATE) AS day, max(value) AS v FROM events GROUP BY 1, 2, 3), c AS (SELECT event_type,
cell, d.day FROM (SELECT DISTINCT event_type, cell FROM e) x, (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d)
SELECT c.event_type, c.cell, c.day, last_value(v IGNORE NULLS) OVER (PARTITION BY c.event_type, c.cell
ORDER BY c.day ROWS UNBOUNDED PRECEDING) AS held, CAST(coalesce(round_even(v * 10, 0), -32768) AS INT) AS packed FROM c LEFT
JOIN e ON e.event_type = c.event_type AND e.cell = c.cell AND e.day = c.day""")
def hold_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of days: the last value holds over gaps; stored as tenths with a no-data code."""
    ev = table(spark, sf_dir, "events").withColumn("cell", F.col("user_id") % 24).withColumn("day", F.to_date("ts"))
    e = ev.groupBy("event_type", "cell", "day").agg(F.max("value").alias("v"))
    cube = e.select("event_type", "cell").distinct().join(ev.select("day").distinct()).join(e, ["event_type", "cell", "day"], "left")
    w = Window.partitionBy("event_type", "cell").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return cube.select("event_type", "cell", "day", F.last("v", ignorenulls=True).over(w).alias("held"), F.coalesce(F.bround(F.col("v") * 10), F.lit(-32768)).cast("int").alias("packed"))


#: Zone 10 by the published third-order series, from the ellipsoid's axis and flattening on; stands apart from the functions that it checks.
UTM_SQL = """k0 AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257222101::DOUBLE AS f), k1 AS (SELECT *, f / (2 - f) AS n, sqrt(f * (2 - f)) AS e FROM k0),
k AS (SELECT *, 0.9996::DOUBLE * a / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS r,
n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS c1, 13 * n * n / 48 - 3 * n * n * n / 5 AS c2, 61 * n * n * n / 240 AS c3 FROM k1),
p AS (SELECT c_custkey, 36 + (c_custkey * 7919 % 1000) / 250.0::DOUBLE AS lat, -124 + (c_custkey * 104729 % 1000) / 250.0::DOUBLE AS lon
FROM customer),
t AS (SELECT p.*, k.*, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t, radians(lon + 123.0) AS lam FROM p, k),
u AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t),
utm AS (SELECT c_custkey, lat, lon, 500000.0 + r * (eta + c1 * cos(2 * xi) * sinh(2 * eta) + c2 * cos(4 * xi) * sinh(4 * eta) + c3 * cos(6 * xi) * sinh(6 * eta)) AS easting,
  r * (xi + c1 * sin(2 * xi) * cosh(2 * eta) + c2 * sin(4 * xi) * cosh(4 * eta) + c3 * sin(6 * xi) * cosh(6 * eta)) AS northing FROM u)"""


@query(f"WITH {UTM_SQL} SELECT c_custkey, round(easting, 3) AS easting, round(northing, 3) AS northing, round((lon + 180.0) / 360.0 * 262144.0, 3) AS px, round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 262144.0, 3) AS py FROM utm")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in UTM and in Mercator pixels, to the millimetre."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k, (36 + (k * 7919 % 1000) / 250.0).alias("lat"), (-124 + (k * 104729 % 1000) / 250.0).alias("lon"))
    (x, y), (px, py) = E.utm(F.col("lat"), F.col("lon"), 10), E.mercator_pixel(F.col("lat"), F.col("lon"), 10)
    return p.select(k, F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"), F.round(px, 3).alias("px"), F.round(py, 3).alias("py"))


QUATS = "q AS (SELECT vec_id, embedding[1] AS w, embedding[2] AS x, embedding[3] AS y, embedding[4] AS z FROM embeddings), n AS (SELECT vec_id, w / s AS w, x / s AS x, y / s AS y, z / s AS z FROM (SELECT vec_id, CAST(w AS DOUBLE) AS w, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, sqrt(CAST(w AS DOUBLE) * w + CAST(x AS DOUBLE) * x + CAST(y AS DOUBLE) * y + CAST(z AS DOUBLE) * z) AS s FROM q) t WHERE s > 0)"


def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    s = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2] + e[3] * e[3])
    return table(spark, sf_dir, "embeddings").where(s > 0).select("vec_id", F.struct(*[(v / s).alias(k) for v, k in zip(e, "wxyz", strict=True)]).alias("q"))


@query(f"""WITH {QUATS}, d AS (SELECT a.vec_id, a.w AS aw, a.x AS ax, a.y AS ay, a.z AS az, b.w AS bw, b.x AS bx, b.y AS by_, b.z AS bz,
a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z AS raw FROM n a JOIN n b ON b.vec_id = a.vec_id + 1),
t AS (SELECT *, CASE WHEN raw < 0 THEN -1.0 ELSE 1.0 END AS sg, least(1.0, abs(raw)) AS dot FROM d), f AS (SELECT *, CASE
WHEN dot > 0.9995 THEN 0.75 ELSE sin(0.75 * acos(dot)) / sin(acos(dot)) END AS fa, sg * CASE
WHEN dot > 0.9995 THEN 0.25 ELSE sin(0.25 * acos(dot)) / sin(acos(dot)) END AS fb FROM t),
m AS (SELECT *, fa * aw + fb * bw AS sw, fa * ax + fb * bx AS sx, fa * ay + fb * by_ AS sy, fa * az + fb * bz AS sz FROM f)
SELECT vec_id, round(aw * bw - ax * bx - ay * by_ - az * bz, 6) AS pw, round(aw * bx + ax * bw + ay * bz - az * by_, 6) AS px,
round(sw / sqrt(sw * sw + sx * sx + sy * sy + sz * sz), 6) AS sw, round(sz / sqrt(sw * sw + sx * sx + sy * sy + sz * sz), 6) AS sz FROM m""")
def quaternion_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product with the next rotation and a quarter of the way to it."""
    q = quaternions(spark, sf_dir)
    j = q.select("vec_id", F.col("q").alias("a")).join(q.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("b")), "vec_id")
    j = j.withColumn("p", E.quaternion_product(F.col("a"), F.col("b"))).withColumn("s", E.slerp(F.col("a"), F.col("b"), F.lit(0.25)))
    return j.select("vec_id", F.round("p.w", 6).alias("pw"), F.round("p.x", 6).alias("px"), F.round("s.w", 6).alias("sw"), F.round("s.z", 6).alias("sz"))


@query("""WITH r AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS k FROM part GROUP BY 1), h AS (SELECT p_brand, k,
k * 0.618033988749895 - floor(k * 0.618033988749895) AS hue FROM r),
c AS (SELECT p_brand, hue + 1 / 3.0 - floor(hue + 1 / 3.0) AS r, hue AS g, hue - 1 / 3.0 - floor(hue - 1 / 3.0) AS b FROM h), v AS (SELECT p_brand,
list_transform([r, g, b], lambda x: CAST(floor((CASE WHEN x < 1 / 6.0 THEN 0.4 + 0.4 * 6 * x WHEN x < 0.5 THEN 0.8
WHEN x < 2 / 3.0 THEN 0.4 + 0.4 * (2 / 3.0 - x) * 6 ELSE 0.4 END) * 255 + 0.5) AS INT)) AS v FROM c)
SELECT p_brand, printf('#%02x%02x%02x', v[1], v[2], v[3]) AS colour FROM v""")
def colour_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden-angle hues by rank; the window sees one row a brand."""
    r = table(spark, sf_dir, "part").groupBy("p_brand").count().withColumn("k", F.row_number().over(Window.orderBy(F.desc("count"), "p_brand")) - 1)
    return r.select("p_brand", E.wheel(F.col("k")).alias("colour"))


RIVER = "edges_ AS (SELECT p_partkey AS up, p_partkey // 2 AS down FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0 AND p_partkey % 10 = 0)"


@query(f"""WITH RECURSIVE {RIVER}, fan AS (SELECT up, count(*) AS ways FROM edges_ GROUP BY 1), walk AS (SELECT p_partkey AS source, p_partkey AS node,
CAST(p_size AS DOUBLE) AS w FROM part UNION ALL SELECT source, down, w / ways FROM walk JOIN edges_ ON up = node JOIN fan ON fan.up = node)
SELECT node, round(sum(w), 6) AS total FROM walk GROUP BY 1""")
def arbolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream length of a braided network, by topological levels."""
    p = table(spark, sf_dir, "part")
    tree = p.where("p_partkey > 0").select(F.col("p_partkey").alias("up"), F.floor(F.col("p_partkey") / 2).alias("down"))
    braid = p.where("p_partkey > 0 and p_partkey % 10 = 0").select(F.col("p_partkey").alias("up"), F.floor(F.col("p_partkey") / 3).alias("down"))
    out = graph.upstream_totals(p.select(F.col("p_partkey").alias("node"), F.col("p_size").alias("length")), tree.unionByName(braid), cut_cycles=True)
    return out.select("node", F.round("total", 6).alias("total"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey // 2 AS b FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey, n_regionkey
FROM nation WHERE n_nationkey > 10), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c""")
def containment_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    e = n.where("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("a"), F.floor(F.col("n_nationkey") / 2).alias("b")).unionByName(n.where("n_nationkey > 10").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b")))
    return graph.closure(e).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))


@query(f"""WITH RECURSIVE {EDGES}, c AS (SELECT poly, avg(x) AS x, avg(y) AS y FROM edges WHERE ring = 0 GROUP BY 1), p AS (SELECT a.poly AS a, b.poly AS b,
sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS gap FROM c a JOIN c b ON a.poly <> b.poly),
s AS (SELECT 0 AS step, 0 AS poly, CAST(0 AS DOUBLE) AS gap, [0] AS seen UNION ALL SELECT step + 1, nxt.b, nxt.gap, list_append(seen, nxt.b)
  FROM (SELECT s.step, s.seen, min({{'far': NOT (p.a = s.poly AND p.gap <= 15), 'gap': p.gap, 'b': p.b}}) AS nxt FROM s
JOIN p ON list_contains(s.seen, p.a) AND NOT list_contains(s.seen, p.b) GROUP BY s.step, s.seen) x)
SELECT step, poly, round(gap, 6) AS gap FROM s""")
def greedy_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit order of the areas: the nearest that touches the last one, else the nearest to any."""
    c = edges(spark, sf_dir).where("ring = 0").groupBy("poly").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    items = c.select(F.lit(0).alias("grp"), F.col("poly").alias("item"), F.lit(None).cast("long").alias("parent"), "x", "y", F.lit(0.0).alias("r"))
    return graph.visit_orders(items, 15.0, by_last=True).select("step", F.col("item").cast("int").alias("poly"), F.round("gap", 6).alias("gap"))


@query("""WITH RECURSIVE i AS (SELECT c_custkey // 40 AS grp, c_custkey AS item, CASE WHEN c_custkey % 4 = 3 THEN c_custkey - 2
WHEN c_custkey % 4 = 1 THEN c_custkey - 1 END AS up, c_custkey * 7919 % 101 AS x, c_custkey * 104729 % 103 AS y, c_custkey % 5 AS r FROM customer),
n AS (SELECT c.*, p.item AS parent, list_filter([p.item, g.item], lambda v: v IS NOT NULL) AS above FROM i c LEFT JOIN i p ON p.item = c.up AND p.grp = c.grp
LEFT JOIN i g ON g.item = p.up AND g.grp = c.grp),
p AS (SELECT a.grp, a.item AS a, b.item AS b, b.above, b.parent, sqrt(CAST((a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS DOUBLE)) AS far,
greatest(0, sqrt(CAST((a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS DOUBLE)) - b.r - a.r) AS gap FROM n a JOIN n b ON a.grp = b.grp AND a.item <> b.item),
s AS (SELECT grp, 0 AS step, min(item) AS item, 'start' AS why, false AS promoted, CAST(0 AS DOUBLE) AS gap, [min(item)] AS seen FROM n GROUP BY 1 UNION ALL
  SELECT grp, step + 1, coalesce(nxt.parent, nxt.b), CASE WHEN nxt.apart THEN 'closest' ELSE 'touches' END, nxt.parent IS NOT NULL, nxt.far,
  list_append(seen, coalesce(nxt.parent, nxt.b)) FROM (
    SELECT grp, step, seen, min({'apart': near > 6, 'far': CASE WHEN near > 6 THEN near ELSE last END, 'b': b, 'parent': parent}) AS nxt FROM (
      SELECT s.grp, s.step, s.seen, p.b, p.parent, min(p.gap) AS near, min(CASE WHEN p.a = s.item THEN p.far END) AS last FROM s JOIN p ON p.grp = s.grp
      AND list_contains(s.seen, p.a) AND NOT list_contains(s.seen, p.b) AND NOT list_has_any(s.seen, p.above) GROUP BY ALL) q GROUP BY ALL) w)
SELECT grp, step, item, why, promoted, round(gap, 6) AS gap FROM s""")
def visit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit order of each block of customers: what touches the visited first, then the closest; what lies within another gives way to it."""
    k = F.col("c_custkey")
    up = F.when(k % 4 == 3, k - 2).when(k % 4 == 1, k - 1)
    place = [(k * 7919 % 101).alias("x"), (k * 104729 % 103).alias("y"), (k % 5).alias("r")]
    items = table(spark, sf_dir, "customer").select(F.floor(k / 40).alias("grp"), k.alias("item"), up.alias("parent"), *place)
    return graph.visit_orders(items, 6.0).withColumn("gap", F.round("gap", 6))


@query(f"""WITH RECURSIVE {POINTS}, ends AS (SELECT line, max(seq) AS last, count(*) AS n FROM pts GROUP BY 1),
s AS (SELECT line, CAST(0 AS BIGINT) AS lo, last AS hi FROM ends UNION ALL SELECT line, unnest([lo, mid]) AS lo, unnest([mid, hi]) AS hi FROM (
  SELECT line, lo, hi, 0 - (max({{'d': d, 'm': 0 - seq}}))['m'] AS mid, max(d) AS far FROM (
    SELECT line, lo, hi, seq, sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2) AS d FROM (
      SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE,
(px * dx + py * dy) / CAST(dx * dx + dy * dy AS DOUBLE))) END AS t FROM (
        SELECT s.line, s.lo, s.hi, p.seq, p.x - a.x AS px, p.y - a.y AS py, b.x - a.x AS dx, b.y - a.y AS dy FROM s JOIN pts a ON a.line = s.line
AND a.seq = s.lo JOIN pts b ON b.line = s.line AND b.seq = s.hi JOIN pts p ON p.line = s.line AND p.seq > s.lo AND p.seq < s.hi) q1) q2) q3
GROUP BY line, lo, hi) w WHERE far > 60),
k AS (SELECT line, lo AS v FROM s UNION SELECT line, hi FROM s)
SELECT k.line, CAST(any_value(n) AS INT) AS n, CAST(count(*) AS INT) AS n_kept, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS kept FROM k
JOIN ends ON ends.line = k.line GROUP BY 1""")
def simplify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices that a tolerance of 60 keeps in each line; a line is one row with its vertices as an array."""
    from geostrata.functions.simplify import keep_vertices

    lines = points(spark, sf_dir).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("pts"))
    kept = lines.select("line", F.size("pts").alias("n"), keep_vertices(60.0)(F.transform("pts", lambda p: p["x"].cast("double")), F.transform("pts", lambda p: p["y"].cast("double"))).alias("kept"))
    return kept.select("line", "n", F.size("kept").alias("n_kept"), F.array_join(F.transform("kept", lambda k: k.cast("string")), ",").alias("kept"))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def daily_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of ``streaming.jobs.daily``."""
    return jobs.daily(jobs.events(spark, sf_dir)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), w AS (SELECT d.d - CAST(k.range AS INT) AS start FROM d, range(7) k GROUP BY 1)
SELECT CAST(CAST(start AS DATE) AS VARCHAR) AS start, count(*) AS n, round(max(value), 4) AS top FROM w JOIN events ON CAST(ts AS DATE) >= start
AND CAST(ts AS DATE) < start + 7 GROUP BY 1""")
def trailing_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing weeks by day: the batch form of ``streaming.jobs.trailing``."""
    return jobs.trailing(jobs.events(spark, sf_dir)).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n", F.round("top", 4).alias("top"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of six hours: the batch form of ``streaming.jobs.sessions``."""
    return jobs.sessions(jobs.events(spark, sf_dir), "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, user_id % 24 AS cell, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3)
SELECT event_type, CAST(month(day) AS INT) AS m, count(*) AS cells, round(sum(value), 4) AS total FROM d GROUP BY 1, 2""")
def revised_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest revision of each unit of the cube, as the ingest stream leaves it."""
    e = jobs.events(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("cell", F.col("user_id") % 24)
    d = e.groupBy("event_type", "day", "cell").agg(F.max_by("value", "event_id").alias("value"))
    return d.groupBy("event_type", F.month("day").alias("m")).agg(F.count("*").alias("cells"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS failures, CASE
WHEN count(*) FILTER (WHERE event_type = 'click') >= 3 THEN 'blocked' ELSE 'ready' END AS state FROM events GROUP BY 1""")
def retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry counters with a terminal state: what ``streaming.jobs.retries`` ends with."""
    f = F.count_if(F.col("event_type") == "click")
    return jobs.events(spark, sf_dir).groupBy("user_id").agg(f.alias("failures"), F.when(f >= 3, "blocked").otherwise("ready").alias("state"))


@query("""WITH b AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id
ORDER BY n DESC NULLS LAST, event_type) AS rank FROM b) SELECT user_id, event_type, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2""")
def top_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return top_n(b, ["user_id"], [F.desc_nulls_last("n"), F.col("event_type")], 2)


#: One turn of the earth at the equator, in kilometres of the planar approximation.
EQUATOR_KM = 2 * math.pi * E.EARTH_KM
