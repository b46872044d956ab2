"""Queries of nested documents: schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions.schema import judged
from geostrata.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: What a document of a part may be.
PART = {
    "type": "object",
    "additionalProperties": False,
    "required": ["id", "size", "tags", "span"],
    "properties": {
        "id": {"type": "string", "pattern": "^p[0-9]+$"},
        "size": {"type": "integer", "minimum": 1, "maximum": 40},
        "tags": {"type": "array", "items": {"enum": ["a", "b", "c"]}, "uniqueItems": True},
        "span": {"$ref": "#/$defs/span"},
        "note": {"type": ["string", "null"]},
    },
    "if": {"properties": {"size": {"const": 5}}, "required": ["size"]},
    "then": {"required": ["note"]},
    "$defs": {"span": {"type": "object", "required": ["older", "younger"], "properties": {"older": {"type": "number", "exclusiveMinimum": 0}, "younger": {"type": "number"}}}},
}


@query("""WITH d AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 23 <> 0 AND p_partkey % 29 <> 0 AS ok, p_partkey % 11 = 0 AS text_size FROM part),
f AS (SELECT k, '/id required' AS rule FROM d WHERE ok AND k % 7 = 0 UNION ALL SELECT k, '/size type' FROM d WHERE ok AND text_size UNION ALL
SELECT k, '/size maximum' FROM d WHERE ok AND NOT text_size AND s > 40
UNION ALL SELECT k, '/tags uniqueItems' FROM d WHERE ok AND k % 13 = 0 UNION ALL SELECT k, '/tags/1 enum' FROM d WHERE ok AND k % 13 = 5 UNION ALL
SELECT k, '/extra additionalProperties' FROM d WHERE ok AND k % 17 = 0
UNION ALL SELECT k, '/span/younger required' FROM d WHERE ok AND k % 19 = 0 UNION ALL SELECT k, '/span/older exclusiveMinimum' FROM d WHERE ok
AND k % 50 = 0
UNION ALL SELECT k, '/note required' FROM d WHERE ok AND NOT text_size AND s = 5 AND k % 2 = 0 UNION ALL SELECT k, ' parse' FROM d WHERE k % 23 <> 0
AND k % 29 = 0)
SELECT rule, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT 'passed', count(*) FROM d WHERE k % 23 <> 0 AND k NOT IN (SELECT k FROM f) UNION ALL
SELECT 'skipped', count(*) FROM d WHERE k % 23 = 0""")
def schema_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all parts, some with breaches, judged by a compiled schema: how often each rule fails at each path, and how many documents pass or are skipped."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    fields = [
        F.when(k % 7 != 0, F.format_string('"id": "p%d"', k)),
        F.when(k % 11 == 0, F.format_string('"size": "%s"', size)).otherwise(F.format_string('"size": %s', size)),
        F.format_string('"tags": ["a", "%s"]', F.when(k % 13 == 0, "a").when(k % 13 == 5, "z").otherwise("b")),
        F.format_string('"span": {"older": %d%s}', k % 50, F.when(k % 19 == 0, "").otherwise(', "younger": 0.5')),
        F.when(k % 2 == 1, F.lit('"note": null')),
        F.when(k % 17 == 0, F.lit('"extra": {"deep": [1]}')),
    ]
    doc = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.when(k % 29 == 0, ",").otherwise(""), F.lit("}"))
    d = table(spark, sf_dir, "part").select(judged(F.when(k % 23 != 0, doc), PART).alias("j"))
    rules = F.transform("j.findings", lambda f: F.concat(f["path"], F.lit(" "), f["rule"]))
    told = F.when(F.col("j.state") == "failed", rules).otherwise(F.array("j.state"))
    return d.select(F.explode(told).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
