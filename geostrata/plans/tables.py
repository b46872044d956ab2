"""Queries of the relational core: filters, joins, aggregates, windows, set operations and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.operators.relational import best_overlap, dictionary, divide, nest, previous, previous_known, runs, share, top_n, tree_digest, upsert
from geostrata.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH m AS (SELECT n_nationkey, n_name, r_name, concat_ws('|', r_name, 'WORLD', CASE WHEN n_nationkey % 3 = 0 THEN 'COAST' END) AS within_,
CASE n_nationkey % 4 WHEN 0 THEN '2019-05-01' WHEN 1 THEN '' END AS valid_end FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, n_name, within_, CAST(row_number() OVER (ORDER BY CASE r_name WHEN 'ASIA' THEN 1 WHEN 'EUROPE' THEN 2 ELSE 3 END,
n_nationkey) AS INT) AS draw FROM m WHERE (valid_end IS NULL OR valid_end = '')
AND list_has_any(string_split(within_, '|'), ['ASIA', 'EUROPE', 'COAST'])""")
def current_version_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in force whose piped list has one of the wanted tokens, listed parents first. The window sees the few areas alone."""
    k = F.col("n_nationkey")
    m = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = m.withColumn("within_", F.concat_ws("|", "r_name", F.lit("WORLD"), F.when(k % 3 == 0, "COAST"))).withColumn("valid_end", F.when(k % 4 == 0, "2019-05-01").when(k % 4 == 1, ""))
    m = m.where("valid_end is null or valid_end = ''").where(F.arrays_overlap(F.split("within_", r"\|"), F.array(*map(F.lit, ("ASIA", "EUROPE", "COAST")))))
    order = F.coalesce(F.nullif(F.array_position(F.array(F.lit("ASIA"), F.lit("EUROPE")), F.col("r_name")), F.lit(0)), F.lit(3))
    return m.withColumn("draw", F.row_number().over(Window.orderBy(order, k))).select("n_nationkey", "n_name", "within_", "draw")


@query("""SELECT c_custkey, c_name, n_name, r_name, coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'P'), 0.0) = 0 AS idle,
count(o_orderkey) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT
JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner joins to the dimensions, then a left join to facts that are aggregated first."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("spent"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "n_name", "r_name", (F.coalesce("spent", F.lit(0.0)) == 0).alias("idle"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem),
o AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders)
SELECT o_custkey AS unit, o_orderkey AS component, (SELECT sum(l_quantity) FROM l WHERE l_orderkey = o_orderkey) AS depth,
coalesce((SELECT min(l_partkey) FROM l WHERE l_orderkey = o_orderkey AND l_linenumber = 1), -1) AS first_part,
string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '/' ORDER BY l_linenumber, l_partkey, l_quantity) AS layers FROM o LEFT
JOIN l ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def nest_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit, component, layers: layers nest into ordered arrays; correlated lookups become one aggregate and a left join."""
    li = table(spark, sf_dir, "lineitem")
    layers = nest(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], "nested")
    layers = layers.withColumn("depth", F.aggregate("nested", F.lit(0.0), lambda a, x: a + x["l_quantity"])).withColumn("layers", F.array_join(F.transform("nested", lambda x: x["l_quantity"].cast("long").cast("string")), "/"))
    layers = layers.withColumn("first_part", F.array_min(F.transform(F.filter("nested", lambda x: x["l_linenumber"] == 1), lambda x: x["l_partkey"])))
    o = table(spark, sf_dir, "orders")
    return o.join(layers, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("component"), "depth", F.coalesce("first_part", F.lit(-1)).alias("first_part"), "layers")


@query("""WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, c_custkey % 3 = 0 AS major, row_number() OVER (PARTITION BY c_nationkey
ORDER BY c_custkey % 3 = 0 DESC, c_acctbal DESC, c_custkey) AS k FROM customer WHERE c_acctbal > 0)
SELECT c_nationkey, c_custkey, c_acctbal, major FROM r WHERE k = 1""")
def major_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_nationkey", "c_custkey", "c_acctbal", (F.col("c_custkey") % 3 == 0).alias("major"))
    return top_n(c, ["c_nationkey"], [F.desc("major"), F.desc("c_acctbal"), F.col("c_custkey")], 1).drop("rank")


LAYERS = """a AS (SELECT p_partkey // 10 AS profile, p_brand AS name, sum(p_size) OVER w - p_size AS top, sum(p_size) OVER w AS bottom FROM part
WINDOW w AS (PARTITION BY p_partkey // 10 ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)),
b AS (SELECT p_partkey // 10 AS profile, p_brand AS name, sum(p_size) OVER w - p_size AS top, sum(p_size) OVER w AS bottom FROM part
WINDOW w AS (PARTITION BY p_partkey // 10 ORDER BY p_partkey DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {LAYERS}, j AS (SELECT a.profile, a.top, a.bottom, a.name, b.name AS match, least(a.bottom, b.bottom) - greatest(a.top, b.top) AS overlap,
row_number() OVER (PARTITION BY a.profile, a.top, a.bottom ORDER BY substr(a.name, 1, 7) = substr(b.name, 1, 7) DESC, least(a.bottom,
b.bottom) - greatest(a.top, b.top) DESC, b.top) AS k FROM a JOIN b ON a.profile = b.profile AND least(a.bottom, b.bottom) > greatest(a.top, b.top))
SELECT profile, CAST(top AS BIGINT) AS top, CAST(bottom AS BIGINT) AS bottom, name, match, CAST(overlap AS BIGINT) AS overlap FROM j WHERE k = 1""")
def layer_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    def layers(order) -> DataFrame:
        w = Window.partitionBy("profile").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        p = table(spark, sf_dir, "part").withColumn("profile", F.floor(F.col("p_partkey") / 10))
        return p.withColumn("bottom", F.sum("p_size").over(w)).select("profile", F.col("p_brand").alias("name"), (F.col("bottom") - F.col("p_size")).alias("top"), "bottom")

    a, b = layers(F.asc("p_partkey")), layers(F.desc("p_partkey"))
    out = best_overlap(a, b, "profile", F.substring("name", 1, 7) == F.substring("r_name", 1, 7), [F.col("r_top")], band=100)
    return out.select("profile", "top", "bottom", "name", F.col("r_name").alias("match"), "overlap")


@query("""WITH legend AS (SELECT p_type AS t, min(p_brand) AS colour FROM part WHERE p_size > 40 GROUP BY 1), extra AS (SELECT p_type AS t,
min(p_name) AS colour FROM part GROUP BY 1)
SELECT p_partkey, coalesce(legend.colour, extra.colour, 'none') AS colour, legend.t IS NULL AS fallback FROM part LEFT
JOIN legend ON p_type = legend.t LEFT JOIN extra ON p_type = extra.t""")
def legend_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First match of two dictionaries."""
    p = table(spark, sf_dir, "part")
    legend = p.where("p_size > 40").groupBy(F.col("p_type").alias("t")).agg(F.min("p_brand").alias("c1"))
    extra = p.groupBy(F.col("p_type").alias("u")).agg(F.min("p_name").alias("c2"))
    return p.join(legend, F.col("p_type") == F.col("t"), "left").join(extra, F.col("p_type") == F.col("u"), "left").select("p_partkey", F.coalesce("c1", "c2", F.lit("none")).alias("colour"), F.col("t").isNull().alias("fallback"))


@query("""WITH px AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('#%02x%02x%02x', CAST(l_partkey % 4 AS INT),
CAST(l_suppkey % 3 AS INT), 0) AS hex FROM lineitem), legend AS (SELECT printf('#%02x%02x%02x', r.range, g.range, 0) AS hex,
r.range * 3 + g.range AS cls FROM range(4) r, range(2) g)
SELECT cls, count(*) AS pixels FROM px LEFT JOIN legend USING (hex) GROUP BY 1""")
def reverse_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to classes by colour; a colour without class is null."""
    hex_ = lambda r, g: F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), F.lit(0))
    px = table(spark, sf_dir, "lineitem").select(hex_(F.col("l_partkey") % 4, F.col("l_suppkey") % 3).alias("hex"))
    legend = spark.range(4).toDF("r").join(spark.range(2).toDF("g")).select(hex_(F.col("r"), F.col("g")).alias("hex"), (F.col("r") * 3 + F.col("g")).alias("cls"))
    return px.join(legend, "hex", "left").groupBy("cls").agg(F.count("*").alias("pixels"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) AS rec, c_name FROM customer), b AS (SELECT o_custkey + 1 AS rec,
max(o_totalprice) AS geometry FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1)
SELECT a.rec, c_name, geometry FROM a JOIN b ON a.rec = b.rec WHERE geometry IS NOT NULL""")
def zip_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes and shapes meet by record number, which readers emit."""
    a = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("rec"), "c_name")  # keys count from 0 without gaps
    b = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").groupBy((F.col("o_custkey") + 1).alias("rec")).agg(F.max("o_totalprice").alias("geometry"))
    return a.join(b, "rec").where("geometry is not null")


@query("""WITH i AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS square, o_orderkey AS id, o_totalprice % 100 AS cloud, CASE
WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 10) / 10.0 END AS nodata FROM orders),
ok AS (SELECT *, row_number() OVER (PARTITION BY day, square ORDER BY cloud, id) AS k FROM i WHERE coalesce(nodata, 0) <= 0.5
AND coalesce(cloud, 100) <= 70)
SELECT day, CAST(count(*) AS BIGINT) AS squares, max(cloud) AS worst, CAST(row_number() OVER (ORDER BY max(cloud), day DESC) AS INT) AS choice FROM ok
WHERE k = 1 GROUP BY 1 HAVING count(*) = 5""")
def all_squares_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with an acceptable scene in every square, the clearest and then the latest first. The last window sees one row a day."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("square"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 100).alias("cloud"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 10) / 10.0).alias("nodata"))
    best = top_n(o.where("coalesce(nodata, 0) <= 0.5 and coalesce(cloud, 100) <= 70"), ["day", "square"], [F.col("cloud"), F.col("id")], 1)
    whole = best.join(divide(best, "day", "square", 5), "day", "left_semi").groupBy("day").agg(F.count("*").alias("squares"), F.max("cloud").alias("worst"))
    return whole.withColumn("choice", F.row_number().over(Window.orderBy("worst", F.desc("day"))))


@query("""WITH t AS (SELECT page_id, url, regexp_extract(url, '/([a-z]{2})/', 1) AS code FROM pages), o AS (SELECT code, min(page_id) AS owner FROM t
WHERE page_id % 3 = 0 GROUP BY 1)
SELECT t.page_id, coalesce(CAST(owner AS VARCHAR), url) AS label, owner IS NOT NULL AS overridden FROM t LEFT JOIN o ON t.code = o.code
AND t.page_id % 5 <> 0""")
def override_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("code"))
    o = t.where("page_id % 3 = 0").groupBy(F.col("code").alias("c")).agg(F.min("page_id").alias("owner"))
    return t.join(o, (F.col("code") == F.col("c")) & (F.col("page_id") % 5 != 0), "left").select("page_id", F.coalesce(F.col("owner").cast("string"), F.col("url")).alias("label"), F.col("owner").isNotNull().alias("overridden"))


@query("""SELECT o_orderkey, k.sq AS square FROM orders JOIN (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS sq
FROM orders) k ON regexp_matches('T' || o_orderpriority || '_' || o_orderstatus, 'T' || k.sq || '.*_F')""")
def pattern_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keys = o.select(F.substring("o_orderpriority", 1, 1).alias("square")).distinct()
    scene = F.concat(F.lit("T"), "o_orderpriority", F.lit("_"), "o_orderstatus")
    return o.withColumn("scene", scene).withColumn("key", F.regexp_extract("scene", "^T(.)", 1)).join(keys, F.col("key") == F.col("square")).where("scene rlike '^T.*_F'").select("o_orderkey", "square")


@query("""SELECT CASE WHEN GROUPING(p_brand) = 1 THEN 'all' ELSE p_brand END AS brand, CASE WHEN GROUPING(p_type) = 1 THEN 'all' ELSE p_type END AS kind,
count(*) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sources FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY ROLLUP (p_brand, p_type)""")
def class_source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by class with the set of sources, rolled up. The fact table is counted by part before the join."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("c"))
    j = per.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    r = j.rollup("p_brand", "p_type").agg(F.sum("c").alias("n"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("sources"), F.grouping("p_brand").alias("gb"), F.grouping("p_type").alias("gt"))
    return r.select(F.when(F.col("gb") == 1, "all").otherwise(F.col("p_brand")).alias("brand"), F.when(F.col("gt") == 1, "all").otherwise(F.col("p_type")).alias("kind"), "n", "sources")


@query("""SELECT p_brand, round(100.0 * sum(CASE WHEN regexp_matches(lower(p_type), 'brass|steel') THEN p_size ELSE 0 END) / CASE
WHEN sum(p_size) = 0 THEN 1 ELSE sum(p_size) END, 6) AS metal, round(100.0 * sum(CASE
WHEN regexp_matches(lower(p_type), 'steel|small') THEN p_size ELSE 0 END) / CASE WHEN sum(p_size) = 0 THEN 1 ELSE sum(p_size) END, 6) AS small
FROM part GROUP BY 1""")
def keyword_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of keyword groups, which may overlap."""
    total = F.when(F.sum("p_size") == 0, 1).otherwise(F.sum("p_size"))
    pct = lambda words, name: F.round(100.0 * F.sum(F.when(F.lower("p_type").rlike(words), F.col("p_size")).otherwise(0)) / total, 6).alias(name)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(pct("brass|steel", "metal"), pct("steel|small", "small"))


@query("""SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY 1, 2""")
def dict_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(table(spark, sf_dir, "part"), "p_type", ["p_partkey"], ["p_brand"]).select("p_brand", "p_type", "code")


@query("""WITH b AS (SELECT p_type, p_brand, min(p_partkey) AS seen, sum(p_size) AS size FROM part GROUP BY 1, 2), r AS (SELECT *,
row_number() OVER (PARTITION BY p_type ORDER BY seen) AS k FROM b)
SELECT p_type, p_brand, CAST(size AS BIGINT) AS size, CAST(k AS INT) AS rank FROM r WHERE k <= 3""")
def merge_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one name merged, the first three to appear."""
    b = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("seen"), F.sum("p_size").alias("size"))
    return top_n(b, ["p_type"], [F.col("seen")], 3).select("p_type", "p_brand", "size", "rank")


@query("""SELECT p_name AS name, max(p_retailprice) AS length FROM part GROUP BY 1 ORDER BY length DESC, name LIMIT 8""")
def longest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.max("p_retailprice").alias("length")).orderBy(F.desc("length"), "name").limit(8)


@query("""WITH a AS (SELECT p_brand, p_partkey AS k, p_partkey || ':' || sha256(p_name) AS d FROM part), b AS (SELECT p_brand, k // 256 AS k,
sha256(string_agg(d, '' ORDER BY k)) AS d FROM a GROUP BY p_brand, k // 256),
c AS (SELECT p_brand, k // 256 AS k, sha256(string_agg(d, '' ORDER BY k)) AS d FROM b GROUP BY p_brand, k // 256), e AS (SELECT p_brand,
k // 256 AS k, sha256(string_agg(d, '' ORDER BY k)) AS d FROM c GROUP BY p_brand, k // 256)
SELECT p_brand, sha256(string_agg(d, '' ORDER BY k)) AS digest FROM e GROUP BY 1""")
def set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a set, as a tree: of digests of 256 neighbours in key order, and of those again, so that no row holds more."""
    member = F.concat(F.col("p_partkey").cast("string"), F.lit(":"), F.sha2("p_name", 256))
    return tree_digest(table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("k"), member.alias("d")), ["p_brand"], "k", "d", 256, 3).withColumnRenamed("d", "digest")


@query("""WITH y AS (SELECT *, CAST(year(o_orderdate) AS INT) AS y FROM orders) SELECT y, count(*) AS n, y < (SELECT max(y) FROM y) - 4 AS old FROM y GROUP BY 1""")
def retention_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years beyond the last five. The window sees one row a year."""
    n = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return n.withColumn("old", F.col("y") < F.max("y").over(Window.partitionBy()) - 4)


@query("""WITH old AS (SELECT p_partkey AS id, p_name AS title, 1 AS version FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey AS id,
upper(p_name) AS title, 2 AS version FROM part WHERE p_partkey % 2 = 0)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)""")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(1).alias("version"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("title"), F.lit(2).alias("version"))
    return upsert(old, new, "id")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 3000)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k
FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'difference', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'concat',
count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, sf_dir, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("k"))
    tally = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return tally("union", a.union(b).distinct()).unionByName(tally("intersect", a.intersect(b))).unionByName(tally("difference", a.subtract(b))).unionByName(tally("concat", a.unionByName(b)))


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS age FROM orders), w AS (SELECT o_custkey, o_orderkey, age,
lag(age) OVER w AS before_, last_value(age IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate,
o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, count(*) FILTER (WHERE age > before_) AS next_breaks, count(*) FILTER (WHERE age > known) AS known_breaks FROM w GROUP BY 1""")
def ordering_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order breaks against the row before, where a null suppresses the check, and against the last known value."""
    o = table(spark, sf_dir, "orders").withColumn("age", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")))
    keys, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    w = o.withColumn("before_", previous("age", keys, order)).withColumn("known", previous_known("age", keys, order))
    return w.groupBy("o_custkey").agg(F.count_if(F.col("age") > F.col("before_")).alias("next_breaks"), F.count_if(F.col("age") > F.col("known")).alias("known_breaks"))


@query("""WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY 1, 2, 3""")
def sequence_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.lag("event_type").over(w) != F.col("event_type"))
    return e.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1), n AS (SELECT n_nationkey, n_name, r_name FROM nation
JOIN region ON n_regionkey = r_regionkey), s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT n_name, r_name, count(*) AS customers, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS orders, round(sum(total), 2) AS total,
coalesce(max(suppliers), 0) AS suppliers FROM n JOIN customer ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey LEFT
JOIN s ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def multi_source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of each area from five sources, each aggregated before it is joined."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum(F.coalesce("n", F.lit(0))).alias("orders"), F.round(F.sum("total"), 2).alias("total"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey")).join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_name", "r_name", "customers", "orders", "total", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""WITH b AS (SELECT doc_id, lang, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running, source FROM documents) SELECT source, count(*) FILTER (WHERE running <= 60000) AS fit, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE running <= 60000), '') AS ids, CAST(sum(n_chars) AS BIGINT) AS total FROM b GROUP BY 1""")
def budgeted_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each group, in order, as long as the running length keeps within the budget, and the group's whole length.

    Lengths are summed by blocks of a thousand ids first, then inside each block, so that no window holds a group. Equal ids are summed as one.
    """
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.floor(F.col("doc_id") / 1000).alias("block"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    blocks = d.groupBy("source", "block").agg(F.sum("n_chars").alias("size")).withColumn("before", before).select(F.col("source").alias("s"), F.col("block").alias("b"), "before")
    inside = F.sum("n_chars").over(Window.partitionBy("source", "block").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    met = d.withColumn("inside", inside).join(blocks, F.col("source").eqNullSafe(F.col("s")) & F.col("block").eqNullSafe(F.col("b")))
    running = F.coalesce(F.col("before") + F.col("inside"), "before", "inside")  # null only if no length is known so far
    b = met.withColumn("fits", F.coalesce(running <= 60000, F.lit(False)))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.col("doc_id")))), lambda x: x.cast("string")), ",")
    return b.groupBy("source").agg(F.count_if("fits").alias("fit"), ids.alias("ids"), F.sum("n_chars").alias("total"))


@query("""SELECT p_type, p_brand, round(100.0 * sum(p_size) / sum(sum(p_size)) OVER (PARTITION BY p_type), 6) AS pct FROM part GROUP BY 1, 2""")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.sum("p_size").alias("size"))
    return s.select("p_type", "p_brand", F.round(share(F.col("size"), ["p_type"]), 6).alias("pct"))


@query("""SELECT o.o_orderkey, coalesce(sum(l_quantity), 0.0) AS quantity FROM orders o LEFT JOIN lineitem l ON l_orderkey = o_orderkey AND l_returnflag = 'R'
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') AND EXISTS (SELECT 1 FROM lineitem x
WHERE x.l_orderkey = o_orderkey AND x.l_discount > 0.05) GROUP BY 1""")
def semi_anti_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join to an aggregate, an anti join and a semi join."""
    li = table(spark, sf_dir, "lineitem")
    q = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    o = o.join(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    o = o.join(li.where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return o.join(q, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("quantity", F.lit(0.0)).alias("quantity"))
