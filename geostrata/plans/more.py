"""Queries over nested geometry, further projections, rotation chains, gates and quantised outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.functions import expressions as E
from geostrata.operators import graph
from geostrata.plans.bindings import EDGES, GRID, POINTS, edges, grid, points
from geostrata.plans.series import UTM_SQL
from geostrata.session import table

QUERIES, ORACLES = {}, {}


def _authalic(s: str) -> str:
    """SQL of the authalic function of a sine, for the oracle."""
    return f"(1 - e2) * ({s} / (1 - e2 * {s} * {s}) - ln((1 - e * {s}) / (1 + e * {s})) / (2 * e))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {POINTS}, f AS (SELECT line, list(round(x / 7.0, 2) ORDER BY seq) AS xs, list(round(y / 7.0, 2) ORDER BY seq) AS ys, max(x) - min(x) AS w,
max(y) - min(y) AS h FROM pts GROUP BY 1)
SELECT line, CAST(len(xs) + CASE WHEN xs[1] = xs[-1] AND ys[1] = ys[-1] THEN 0 ELSE 1 END AS INT) AS closed, list_min(xs) AS x0, list_max(xs) AS x1,
list_min(ys) AS y0, list_max(ys) AS y1, greatest(w, h) <= 500 AS fits FROM f""")
def nested_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as arrays of structs: vertices scaled and rounded, rings closed, bounds by array functions, a size limit."""
    g = points(spark, sf_dir).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    g = g.withColumn("r", E.close_ring(F.transform("p", lambda p: F.struct(F.round(p["x"] / 7.0, 2).alias("x"), F.round(p["y"] / 7.0, 2).alias("y")))))
    xs, ys = F.transform("r", lambda p: p["x"]), F.transform("r", lambda p: p["y"])
    extent = lambda v: F.array_max(v) - F.array_min(v)
    wide = F.greatest(extent(F.transform("p", lambda p: p["x"])), extent(F.transform("p", lambda p: p["y"])))
    return g.select("line", F.size("r").alias("closed"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"), (wide <= 500).alias("fits"))


#: Zoom for the oracles, of a box x0, y0, x1, y1 in degrees.
ZOOM_SQL = "greatest(3.0::DOUBLE, least(14.0::DOUBLE, log2(360.0::DOUBLE * 900 / 512 / greatest(x1 - x0, (y1 - y0) / cos(radians((y0 + y1) / 2)), 1e-3::DOUBLE)) - 0.3::DOUBLE))"


@query(f"""WITH {POINTS}, b AS (SELECT line, min(x) / 10.0::DOUBLE AS x0, max(x) / 10.0::DOUBLE AS x1, min(y) / 20.0::DOUBLE AS y0, max(y) / 20.0::DOUBLE AS y1
FROM pts GROUP BY 1)
SELECT line, round((x0 + x1) / 2, 5) AS cx, round((y0 + y1) / 2, 5) AS cy, round({ZOOM_SQL}, 2) AS zoom FROM b""")
def camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and zoom for each line's bounds."""
    b = points(spark, sf_dir).groupBy("line").agg(*[(f(c) / s).alias(f"{c}{i}") for c, s in (("x", 10.0), ("y", 20.0)) for i, f in enumerate((F.min, F.max))])
    v = map_view()
    return b.select("line", v["center"][0].alias("cx"), v["center"][1].alias("cy"), v["zoom"].alias("zoom"))


def map_view() -> Column:
    """Centre, zoom and box of columns x0, y0, x1 and y1, as a project document has them."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    cy = (y0 + y1) / 2
    center = F.array(F.round((x0 + x1) / 2, 5), F.round(cy, 5))
    box = F.array(*[F.round(v, 5) for v in (x0, y0, x1, y1)])
    zoom = F.round(E.camera_zoom(x1 - x0, y1 - y0, cy), 2)
    return F.struct(center.alias("center"), zoom.alias("zoom"), F.lit(0).alias("bearing"), F.lit(0).alias("pitch"), box.alias("bbox"))


def styled_layer(key: str, title: Column, rings: Column, fill: str, opacity: float, stroke: str, width: float) -> Column:
    """A layer of one polygon with its style."""
    style = F.struct(F.lit(fill).alias("fillColor"), F.lit(opacity).alias("fillOpacity"), F.lit(stroke).alias("strokeColor"), F.lit(width).alias("strokeWidth"))
    geometry = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(title.alias("name")).alias("properties"), geometry.alias("geometry"))
    features = F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))
    return F.struct(F.lit(key).alias("id"), title.alias("name"), F.lit(True).alias("visible"), style.alias("style"), features.alias("geojson"))


def _layer_sql(key: str, title: str, rings: str, fill: str, opacity: float, stroke: str, width: float) -> str:
    """SQL of a styled layer, for the oracle."""
    style = f"{{'fillColor': '{fill}', 'fillOpacity': {opacity}::DOUBLE, 'strokeColor': '{stroke}', 'strokeWidth': {width}::DOUBLE}}"
    feature = f"{{'type': 'Feature', 'properties': {{'name': {title}}}, 'geometry': {{'type': 'Polygon', 'coordinates': {rings}}}}}"
    return f"{{'id': '{key}', 'name': {title}, 'visible': true, 'style': {style}, 'geojson': {{'type': 'FeatureCollection', 'features': [{feature}]}}}}"


#: Styles of the layers of a project: key, fill, its opacity, stroke, its width.
FRAME, AREA, GAP = ("frame", "#ffffff", 0.0, "#9aa3ad", 1.5), ("area", "#ffd27a", 0.08, "#d9a520", 2.5), ("gap", "#7fd1a8", 0.12, "#2f9e6e", 1.5)


@query(f"""WITH {EDGES}, r AS (SELECT poly, ring, list([x, y] ORDER BY seq) AS pts FROM edges GROUP BY 1, 2),
c AS (SELECT poly, list(list_append(pts, pts[1]) ORDER BY ring) AS rings FROM r GROUP BY 1),
b AS (SELECT poly, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM edges GROUP BY 1),
p AS (SELECT n_nationkey AS poly, n_name, n_nationkey % 3 > 0 AS mapped, rings, x0, y0, x1, y1, [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0,
y0]] AS box FROM nation JOIN c ON c.poly = n_nationkey JOIN b ON b.poly = n_nationkey)
SELECT poly, CAST(to_json({{'version': '1', 'name': n_name, 'mapView': {{'center': [round((x0 + x1) / 2.0::DOUBLE, 5), round((y0 + y1) / 2.0::DOUBLE, 5)], 'zoom': round({ZOOM_SQL}, 2), 'bearing': 0, 'pitch': 0, 'bbox': [x0::DOUBLE, y0::DOUBLE, x1::DOUBLE, y1::DOUBLE]}},
'layers': list_filter([CASE WHEN mapped THEN {_layer_sql(FRAME[0], "'Frame'", "[box]", *FRAME[1:])} END, {_layer_sql(AREA[0], "n_name", "rings", *AREA[1:])}, CASE WHEN len(rings) > 1 THEN {_layer_sql(GAP[0], "'Gap'", "rings[2:]", *GAP[1:])} END], lambda l: l IS NOT NULL),
'metadata': {{'status': CASE WHEN mapped THEN 'mapped' ELSE 'planned' END, 'sources': list_concat(['areas'], CASE WHEN len(rings) > 1 THEN ['gaps'] ELSE [] END)}}}}) AS VARCHAR) AS document
FROM p""")
def project_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map project for each area as a JSON document: view, styled layers in drawing order, status and sources.

    The frame is a layer of mapped areas alone, the gap one of areas with a hole.
    """
    e = edges(spark, sf_dir)
    rings = e.groupBy("poly", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", F.array("x", "y").alias("at")))).alias("p"), *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))])
    rings = rings.withColumn("closed", E.close_ring(F.transform("p", lambda p: p["at"])))
    sides = [F.min("x0").cast("double").alias("x0"), F.min("y0").cast("double").alias("y0"), F.max("x1").cast("double").alias("x1"), F.max("y1").cast("double").alias("y1")]
    areas = rings.groupBy("poly").agg(F.array_sort(F.collect_list(F.struct("ring", "closed"))).alias("r"), *sides)
    areas = areas.join(table(spark, sf_dir, "nation"), F.col("poly") == F.col("n_nationkey")).withColumn("rings", F.transform("r", lambda r: r["closed"]))
    mapped, holed = F.col("poly") % 3 > 0, F.size("rings") > 1
    corner = lambda x, y: F.array(F.col(x).cast("long"), F.col(y).cast("long"))
    box = F.array(*[corner(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    frame = styled_layer(FRAME[0], F.lit("Frame"), F.array(box), *FRAME[1:])
    gap = styled_layer(GAP[0], F.lit("Gap"), F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))), *GAP[1:])
    layers = F.filter(F.array(F.when(mapped, frame), styled_layer(AREA[0], F.col("n_name"), F.col("rings"), *AREA[1:]), F.when(holed, gap)), lambda x: x.isNotNull())
    metadata = F.struct(F.when(mapped, "mapped").otherwise("planned").alias("status"), F.when(holed, F.array(F.lit("areas"), F.lit("gaps"))).otherwise(F.array(F.lit("areas"))).alias("sources"))
    whole = F.struct(F.lit("1").alias("version"), F.col("n_name").alias("name"), map_view().alias("mapView"), layers.alias("layers"), metadata.alias("metadata"))
    return areas.select("poly", F.to_json(whole).alias("document"))


@query(f"""WITH {GRID}, q AS (SELECT row, col, round_even(least(255, greatest(0, value / 4)), 0) AS value, round_even(least(255, greatest(0, n * 8)), 0) AS n,
round_even(cls * 36.0, 0) AS cls FROM grid), u AS (UNPIVOT q ON value, n, cls INTO NAME field VALUE code)
SELECT field, row, sum(CAST(code AS BIGINT))::BIGINT AS total, CAST(max(code) AS INT) AS top FROM u GROUP BY 1, 2""")
def quantised_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers as one-byte codes with a scale each, as long rows."""
    byte = lambda c: F.bround(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c))).cast("int")
    q = grid(spark, sf_dir).select("row", byte(F.col("value") / 4).alias("value"), byte(F.col("n") * 8.0).alias("n"), byte(F.col("cls") * 36.0).alias("cls"))
    return q.unpivot("row", ["value", "n", "cls"], "field", "code").groupBy("field", "row").agg(F.sum("code").alias("total"), F.max("code").alias("top"))


@query("""SELECT n_nationkey, array_to_string(list_sort(list_distinct(CASE
WHEN n_nationkey % 2 = 0 THEN ['daily', 'soil'] ELSE ['soil'] END || ['daily'])), ',') AS layers,
coalesce(nullif(r.r_name, 'ASIA'), 'elsewhere') AS frame FROM nation LEFT JOIN region r ON r_regionkey = n_regionkey""")
def flag_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag added to a list if it lacks it; a value with a fallback."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    layers = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("daily"), F.lit("soil"))).otherwise(F.array(F.lit("soil")))
    return n.select("n_nationkey", F.array_join(F.sort_array(F.array_union(layers, F.array(F.lit("daily")))), ",").alias("layers"), F.coalesce(F.nullif("r_name", F.lit("ASIA")), F.lit("elsewhere")).alias("frame"))


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 3 END AS parent, radians(p_size * 3.0) AS a
FROM part), c AS (SELECT node, a, node AS root FROM l WHERE parent IS NULL UNION ALL SELECT l.node, l.a + c.a, c.root FROM l
JOIN c ON l.parent = c.node)
SELECT node, root, round(cos(a / 2), 9) AS w, round(sin(a / 2), 9) AS z FROM c""")
def rotation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations composed from the root down; about one pole they add, which the oracle uses."""
    p = table(spark, sf_dir, "part")
    q = E.quaternion_of_pole(F.lit(90.0), F.lit(0.0), F.col("p_size") * 3.0)
    links = p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).alias("parent"), q.alias("value"))
    return graph.compose_chains(links, E.quaternion_product).select("node", "root", F.round("value.w", 9).alias("w"), F.round("value.z", 9).alias("z"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds, sum(o_totalprice) AS total, min(o_totalprice) AS low FROM orders
GROUP BY 1)
SELECT o_custkey, n >= 5 AS enough, kinds = 5 AS whole, total <= 2000000 AS within_budget, low >= 0 AND low <= 1000000 AS in_range, n >= 5
AND kinds = 5 AND total <= 2000000 AND low >= 0 AS release FROM g""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each group and whether all hold."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("kinds"), F.sum("o_totalprice").alias("total"), F.min("o_totalprice").alias("low"))
    checks = {"enough": F.col("n") >= 5, "whole": F.col("kinds") == 5, "within_budget": F.col("total") <= 2000000, "in_range": F.col("low").between(0, 1000000)}
    return g.select("o_custkey", *[c.alias(k) for k, c in checks.items()], (checks["enough"] & checks["whole"] & checks["within_budget"] & (F.col("low") >= 0)).alias("release"))


@query("""SELECT c_custkey, round(36 + (c_custkey * 7919 % 1000) / 250.0, 7) AS lat, round(-124 + (c_custkey * 104729 % 1000) / 250.0, 7) AS lon FROM customer""")
def projection_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTM and back gives the points again, to a centimetre."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k, (36 + (k * 7919 % 1000) / 250.0).alias("lat"), (-124 + (k * 104729 % 1000) / 250.0).alias("lon"))
    e, n = E.utm(F.col("lat"), F.col("lon"), 10)
    lat, lon = E.geographic(F.col("e"), F.col("n"), 10)
    return p.select(k, e.alias("e"), n.alias("n")).select(k, F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(f"""WITH {UTM_SQL}, b AS (SELECT c_custkey, lat, lon, easting, northing, f * (2 - f) AS e2, sqrt(f * (2 - f)) AS e, a FROM utm, k0),
q AS (SELECT *, {_authalic("sin(radians(lat))")} AS qs, {_authalic("sin(radians(23.0))")} AS q0, {_authalic("sin(radians(29.5))")} AS q1, {_authalic("sin(radians(45.5))")} AS q2,
cos(radians(29.5)) ** 2 / (1 - e2 * sin(radians(29.5)) ** 2) AS m1, cos(radians(45.5)) ** 2 / (1 - e2 * sin(radians(45.5)) ** 2) AS m2 FROM b),
n AS (SELECT *, (m1 - m2) / (q2 - q1) AS n FROM q), r AS (SELECT *, a * sqrt(m1 + n * q1 - n * qs) / n AS rho,
a * sqrt(m1 + n * q1 - n * q0) / n AS rho0, n * radians(lon + 96.0) AS theta FROM n)
SELECT c_custkey, round(rho * sin(theta), 3) AS x, round(rho0 - rho * cos(theta), 3) AS y, substr('ABCDEFGH',
CAST(floor(easting / 100000) AS INT), 1) || substr('FGHJKLMNPQRSTUVABCDE', CAST(floor(northing / 100000) AS INT) % 20 + 1, 1) AS square FROM r""")
def equal_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the equal-area grid, with their 100 km squares."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k, (36 + (k * 7919 % 1000) / 250.0).alias("lat"), (-124 + (k * 104729 % 1000) / 250.0).alias("lon"))
    x, y = E.albers(F.col("lat"), F.col("lon"))
    e, n = E.utm(F.col("lat"), F.col("lon"), 10)
    return p.select(k, F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), E.quadkey_square(e, n).alias("square"))


@query("""WITH c AS (SELECT doc_id, text, n_chars FROM documents) SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes,
length(text) = n_chars AS verified, doc_id NOT IN (SELECT doc_id FROM labels) AS unlisted FROM c""")
def ledger_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size of every entry, whether it has the length that its row declares, and whether the ledger lacks it (a warning)."""
    d, listed = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("listed")).distinct()
    digest = F.sha2(F.col("text"), 256)
    return d.join(listed, "doc_id", "left").select("doc_id", digest.alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), (F.char_length("text") == F.col("n_chars")).alias("verified"), F.col("listed").isNull().alias("unlisted"))


@query("""WITH e AS (SELECT n_nationkey AS poly FROM nation), x AS (SELECT poly, poly % 7 * 10 AS older, poly % 5 * 9 AS younger FROM e) SELECT poly,
CAST(greatest(younger, 0) AS INT) AS to_age, older >= younger AS ordered, CAST(older - lag(older, 1, 0) OVER (ORDER BY poly) AS INT) AS step FROM x
WHERE older > 0""")
def interval_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals clipped to the present, their order, and steps between them; a window over the few areas."""
    k = F.col("n_nationkey")
    x = table(spark, sf_dir, "nation").select(k.alias("poly"), (k % 7 * 10).alias("older"), (k % 5 * 9).alias("younger")).where("older > 0")
    return x.select("poly", F.greatest("younger", F.lit(0)).alias("to_age"), (F.col("older") >= F.col("younger")).alias("ordered"), (F.col("older") - F.lag("older", 1, 0).over(Window.orderBy("poly"))).alias("step"))


@query("""WITH e AS (SELECT n_nationkey AS poly, (n_nationkey % 5) * 12 + 1 AS x0 FROM nation)
SELECT poly, 'POLYGON ((' || x0 || ' 0, ' || (x0 + 5) || ' 0, ' || (x0 + 5) || ' 9, ' || x0 || ' 0))' AS wkt, CAST(4 AS INT) AS vertices FROM e""")
def wkt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WKT written and read back."""
    from geostrata.sources.text import wkt_rings

    x = edges(spark, sf_dir).groupBy("poly").agg(F.min(((F.col("poly") % 5) * 12 + 1)).alias("x0"))
    w = x.select("poly", F.format_string("POLYGON ((%d 0, %d 0, %d 9, %d 0))", "x0", F.col("x0") + 5, F.col("x0") + 5, "x0").alias("wkt"))
    return w.select("poly", "wkt", F.size(wkt_rings("wkt")[0]).alias("vertices"))
