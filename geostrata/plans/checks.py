"""Queries of data-quality rules: references in id arrays, keyframes, schemas, pages, integrity values, grid metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.plans.bindings import GRID, grid
from geostrata.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH u AS (SELECT o_custkey AS unit, list(o_orderkey) AS ids FROM orders GROUP BY 1), x AS (SELECT unit, unnest(ids) AS id FROM u),
p AS (SELECT l_orderkey AS unit, list_distinct(list(l_partkey + CASE WHEN l_partkey % 500 = 0 THEN 1000000 ELSE 0 END)) AS ids FROM lineitem
GROUP BY 1), y AS (SELECT unit, unnest(ids) AS id FROM p)
SELECT 'customer' AS relation, unit, id FROM x WHERE unit NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'order', unit, id FROM x WHERE id NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'part', unit, id FROM y WHERE id NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'nation', c_nationkey, c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'region', n_regionkey, n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT 'label', doc_id, doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def id_array_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids inside arrays, and plain keys, that their table lacks: six relations, each by an anti join after the arrays are opened."""
    t = lambda name: table(spark, sf_dir, name)
    units = t("orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.collect_list("o_orderkey").alias("ids"))
    key = F.col("l_partkey") + F.when(F.col("l_partkey") % 500 == 0, 1000000).otherwise(0)
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_set(key).alias("ids"))
    x, y = (df.select("unit", F.explode("ids").alias("id")) for df in (units, lines))
    c = t("customer").select(F.col("c_nationkey").alias("unit"), F.col("c_custkey").alias("id"))
    n = t("nation").select(F.col("n_regionkey").alias("unit"), F.col("n_nationkey").alias("id"))
    d = t("labels").select(F.col("doc_id").alias("unit"), F.col("doc_id").alias("id"))
    relations = [("customer", x, "unit", "customer", "c_custkey"), ("order", x, "id", "lineitem", "l_orderkey"), ("part", y, "id", "part", "p_partkey"), ("nation", c, "unit", "nation", "n_nationkey"), ("region", n, "unit", "region", "r_regionkey"), ("label", d, "id", "documents", "doc_id")]
    out = None
    for name, df, own, other, key in relations:
        lost = df.join(t(other).select(F.col(key).alias("_known")), F.col(own) == F.col("_known"), "left_anti")
        lost = lost.select(F.lit(name).alias("relation"), F.col("unit").cast("long").alias("unit"), F.col("id").cast("long").alias("id"))
        out = lost if out is None else out.unionByName(lost)
    return out


@query("""WITH k AS (SELECT o_custkey AS track, o_orderkey AS seq, datediff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS age, CASE
WHEN o_orderkey % 40 = 0 THEN '' ELSE o_orderpriority END AS label FROM orders),
l AS (SELECT *, lag(age) OVER (PARTITION BY track ORDER BY seq) AS before, row_number() OVER (PARTITION BY track ORDER BY seq DESC) AS back FROM k)
SELECT track, count(*) < 2 AS too_few, coalesce(bool_or(before IS NOT NULL AND before <= age), false) AS unordered, bool_or(back = 1
AND age <> 0) AS no_end, bool_or(label IS NULL OR label = '') AS unlabelled FROM l GROUP BY 1""")
def keyframe_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each track of keyframes: fewer than two, ages that don't fall, a last one that isn't at 0, a missing label. By array functions."""
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate"))
    label = F.when(F.col("o_orderkey") % 40 != 0, F.col("o_orderpriority")).otherwise("")
    k = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), F.struct(F.col("o_orderkey").alias("seq"), age.alias("age"), label.alias("label")).alias("k"))
    t = k.groupBy("track").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    steps = F.arrays_zip(F.slice("ks", 1, F.size("ks") - 1).alias("a"), F.slice("ks", 2, F.size("ks")).alias("b"))
    return t.select(
        "track",
        (F.size("ks") < 2).alias("too_few"),
        F.exists(steps, lambda s: s["a"]["age"] <= s["b"]["age"]).alias("unordered"),
        (F.element_at("ks", -1)["age"] != 0).alias("no_end"),
        F.exists("ks", lambda x: F.coalesce(x["label"], F.lit("")) == "").alias("unlabelled"),
    )


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 13 = 0 THEN NULL
WHEN event_id % 17 = 0 THEN 'broken{' WHEN event_id % 19 = 0 THEN '{"k": 5, "other": 1}' ELSE props END AS raw FROM events),
s AS (SELECT *, json_valid(raw) AS fine, CASE WHEN json_valid(raw) THEN list_sort(json_keys(raw)) END AS keys, CASE WHEN json_valid(raw) THEN TRY_CAST(raw->>'k' AS BIGINT) END AS k FROM e),
r AS (SELECT event_type, 'parses' AS rule, CASE WHEN raw IS NULL THEN 'skipped' WHEN fine THEN 'passed' ELSE 'failed' END AS state FROM s
UNION ALL SELECT event_type, 'closed', CASE WHEN raw IS NULL OR NOT fine THEN 'skipped' WHEN keys = ['k'] THEN 'passed' ELSE 'failed' END FROM s
UNION ALL SELECT event_type, 'range', CASE WHEN raw IS NULL OR NOT fine OR k IS NULL THEN 'skipped' WHEN k BETWEEN 10 AND 80 THEN 'passed' ELSE 'failed' END FROM s)
SELECT event_type, rule, state, count(*) AS n FROM r GROUP BY ALL""")
def schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of rules over JSON values: what a rule can't judge is skipped, which isn't passed."""
    i = F.col("event_id")
    raw = F.when(i % 13 == 0, None).when(i % 17 == 0, "broken{").when(i % 19 == 0, '{"k": 5, "other": 1}').otherwise(F.col("props"))
    e = table(spark, sf_dir, "events").select("event_type", raw.alias("raw"))
    e = e.select("event_type", "raw", F.json_object_keys("raw").alias("keys"), F.from_json("raw", "k BIGINT")["k"].alias("k"))
    fine, none = F.col("keys").isNotNull(), F.col("raw").isNull()
    rules: list[tuple[str, Column, Column]] = [("parses", none, fine), ("closed", none | ~fine, F.array_sort("keys") == F.array(F.lit("k"))), ("range", none | ~fine | F.col("k").isNull(), F.col("k").between(10, 80))]
    judged = F.array(*[F.struct(F.lit(name).alias("rule"), F.when(skip, "skipped").when(ok, "passed").otherwise("failed").alias("state")) for name, skip, ok in rules])
    return e.select("event_type", F.explode(judged).alias("r")).groupBy("event_type", "r.rule", "r.state").agg(F.count("*").alias("n"))


#: Hosts that scripts may come from.
SCRIPT_HOSTS = ("cdn.jsdelivr.net", "unpkg.com")


def page_rule_counts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Of each page: scripts from hosts that aren't allowed, scripts without integrity, new windows without noopener, code made from text."""
    all_ = lambda p, group=0: F.regexp_extract_all(html, F.lit(p), F.lit(group))
    scripts = all_(r"""(?i)<script\b[^>]*\bsrc\s*=\s*["']?(?:https?:)?//[^>]*>""")
    host = lambda s: F.lower(F.regexp_extract(s, r"""(?i)\bsrc\s*=\s*["']?(?:https?:)?//([^/"'\s>:]+)""", 1))
    blank = all_(r"""(?i)<a\b[^>]*\btarget\s*=\s*["']?_blank[^>]*>""")
    return pages.select(
        key,
        F.size(F.filter(scripts, lambda s: ~host(s).isin(*SCRIPT_HOSTS))).alias("foreign_scripts"),
        F.size(F.filter(scripts, lambda s: ~s.rlike(r"(?i)\bintegrity\s*="))).alias("no_integrity"),
        F.size(F.filter(blank, lambda s: ~s.rlike(r"(?i)\bnoopener\b"))).alias("no_noopener"),
        F.size(all_(r"\beval\(|\bnew Function\b|\bdocument\.write\(")).alias("made_code"),
    )


@query(r"""WITH p AS (SELECT page_id, replace(replace(html, '<script>', CASE page_id % 4 WHEN 0 THEN '<script src="https://unpkg.com/a.js" integrity="sha384-x">'
WHEN 1 THEN '<script src="//bad.example/a.js">'
WHEN 2 THEN '<script src="https://unpkg.com/a.js">' ELSE '<script>eval(x);' END), '<a href="/T', '<a target="_blank" href="/T') AS html FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(html, '<script src="//bad')) AS INT) AS foreign_scripts,
CAST(len(regexp_extract_all(html, '<script src="[^"]*">')) AS INT) AS no_integrity,
CAST(len(regexp_extract_all(html, '<a target="_blank"')) AS INT) AS no_noopener, CAST(len(regexp_extract_all(html, 'eval\(')) AS INT) AS made_code
FROM p""")
def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of pages over pages into which some breaches are put."""
    k = F.col("page_id") % 4
    script = F.when(k == 0, '<script src="https://unpkg.com/a.js" integrity="sha384-x">').when(k == 1, '<script src="//bad.example/a.js">').when(k == 2, '<script src="https://unpkg.com/a.js">').otherwise("<script>eval(x);")
    html = F.replace(F.replace("html", F.lit("<script>"), script), F.lit('<a href="/T'), F.lit('<a target="_blank" href="/T'))
    return page_rule_counts(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))


def compared_digests(stored: DataFrame, files: DataFrame, key: str, quoted: str, content: str) -> DataFrame:
    """key, quoted and state of each digest that is stored (``sha256-`` and base64) or file that is there: ok, changed, missing, or unlisted."""
    there = F.concat(F.lit("sha256-"), F.base64(F.unhex(F.sha2(content, 256))))
    found = files.select(F.col(key).alias("_key"), there.alias("_there"), F.lit(True).alias("_is"))
    both = stored.select(key, F.col(quoted).alias("quoted"), F.lit(True).alias("_said")).join(found, F.col(key) == F.col("_key"), "full")
    state = F.when(F.col("_is").isNull(), "missing").when(F.col("_said").isNull(), "unlisted").when(F.col("quoted") == F.col("_there"), "ok").otherwise("changed")
    return both.select(F.coalesce(key, "_key").alias(key), "quoted", state.alias("state"))


@query("""WITH d AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' ' ELSE text END) AS found, sha256(text) AS said FROM documents)
SELECT doc_id, CASE WHEN doc_id % 11 <> 3 THEN 'sha256-' || to_base64(unhex(said)) END AS quoted,
CASE WHEN doc_id % 11 = 3 THEN 'unlisted' WHEN doc_id % 13 = 5 THEN 'missing' WHEN found = said THEN 'ok' ELSE 'changed' END AS state FROM d WHERE doc_id % 11 <> 3 OR doc_id % 13 <> 5""")
def integrity_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of stored digests joined to the files that are there: some have changed since, some are gone, some aren't listed."""
    d, k = table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id")
    stored = d.where(k % 11 != 3).select("doc_id", F.concat(F.lit("sha256-"), F.base64(F.unhex(F.sha2("text", 256)))).alias("said"))
    files = d.where(k % 13 != 5).select("doc_id", F.when(k % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("body"))
    return compared_digests(stored, files, "doc_id", "said", "body")


def checked_grid(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """``cells`` (row, col, value) as they are; an error where a cell lies outside of the grid that its metadata states, or has two values."""
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    once = F.count("*").over(Window.partitionBy("row", "col")) == 1
    bad = F.raise_error(F.concat(F.lit("cell out of grid or given twice: "), F.col("row").cast("string"), F.lit(", "), F.col("col").cast("string"))).cast("double")
    return cells.withColumn("_once", once).withColumn("value", F.when(inside & F.col("_once"), F.col("value")).otherwise(bad)).drop("_once")


@query(f"""WITH {GRID} SELECT 64 AS rows, 64 AS cols, count(*) AS cells, sum(value) AS total, count(*) = count(DISTINCT row * 64 + col) AS one_value,
min(row) >= 0 AND max(row) < 64 AND min(col) >= 0 AND max(col) < 64 AS fits FROM grid""")
def grid_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid held against its metadata: size, one value a cell; the query fails where they don't agree."""
    g = checked_grid(grid(spark, sf_dir).select("row", "col", "value"), 64, 64)
    same = F.count("*") == F.countDistinct(F.col("row") * 64 + F.col("col"))
    fits = (F.min("row") >= 0) & (F.max("row") < 64) & (F.min("col") >= 0) & (F.max("col") < 64)
    return g.agg(F.lit(64).alias("rows"), F.lit(64).alias("cols"), F.count("*").alias("cells"), F.sum("value").alias("total"), same.alias("one_value"), fits.alias("fits"))
