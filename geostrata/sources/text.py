"""Text sources as DataFrame expressions: feature collections, WKT, rotation files, metadata, ledgers, coverage exchange files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, props, kind, rings) of polygons: rings of Polygon and MultiPolygon as one list; coordinates may have a height."""
    doc = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", FEATURES).alias("d"))
    f = doc.select("path", F.posexplode("d.features").alias("ord", "f")).select("path", "ord", F.col("f.properties").alias("props"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    one = F.from_json("c", "array<array<array<double>>>")
    many = F.flatten(F.from_json("c", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("kind") == "MultiPolygon", many).when(F.col("kind") == "Polygon", one)
    return f.select("path", "ord", "props", "kind", F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("rings"))


def wkt_rings(wkt: str) -> Column:
    """Closed rings of four points or more in a WKT text."""
    rings = F.transform(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y"))))
    return F.coalesce(F.filter(rings, lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1))), F.array().cast("array<array<struct<x:double,y:double>>>"))


def rotations(lines: DataFrame) -> DataFrame:
    """(plate, age, lat, lon, angle, fixed, sequence) of numbered rotation lines (n, line): comments and the no-plate 999 left out, a new sequence where the plates change."""
    f = F.split(F.trim(F.regexp_replace("line", "!.*", "")), r"\s+")
    t = lines.withColumn("f", f).where(F.size("f") >= 6)
    t = t.select("n", F.expr("try_cast(f[0] as int)").alias("plate"), *[F.expr(f"try_cast(f[{i}] as double)").alias(c) for i, c in enumerate(("age", "lat", "lon", "angle"), 1)], F.expr("try_cast(f[5] as int)").alias("fixed"))
    t = t.where("plate is not null and fixed is not null and plate <> 999 and plate <> fixed")
    w = Window.partitionBy("plate").orderBy("n")
    new = F.coalesce((F.lag("fixed").over(w) != F.col("fixed")) | (F.lag("n").over(w) != F.col("n") - 1), F.lit(True))
    return t.withColumn("new", new.cast("int")).withColumn("sequence", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def unit_names(text: str) -> Column:
    """Map of code to definition in FGDC metadata; the first definition of a code that isn't blank counts."""
    pattern = r"Enumerated_Domain_Value:\s*([^\n]+?)\s*\n\s*Enumerated_Domain_Value_Definition:[ \t]*([^\n]*)"
    codes = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    names = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda n: F.trim(n))
    pairs = F.filter(F.arrays_zip(codes.alias("k"), names.alias("v")), lambda p: p["v"] != "")
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == p["i"] + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"])))


def ledger_ids(text: str) -> Column:
    """First cells in back quotes of the rows of a Markdown table."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\|\s*`([^`]+)`\s*\|"), F.lit(1)))


def horizons(narrative: str) -> tuple[Column, Column]:
    """Gravel percent and texture words of a layer's description; null where it has none."""
    gravel = F.expr(f"try_cast(nullif(regexp_extract({narrative}, '([0-9]+) percent gravel', 1), '') as int)")
    texture = F.nullif(F.trim(F.regexp_extract(narrative, r"; ((?:very |gravelly |silty |sandy |fine )*(?:sand|loam|silt|clay)(?: loam)?)", 1)), F.lit(""))
    return gravel, texture


#: A layer of a series document; its layers are a list in a list.
_LAYER = "name string, top int, bottom int, texture_class string, narrative string, structure string, " + ", ".join(f"{m}_{c} string" for m in ("dry", "moist") for c in ("hue", "value", "chroma"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Layers of series documents (JSON files): series, place from 0, name, top, bottom, dry and moist colour words, gravel, texture and structure.

    The texture is that of the narrative if it has one, else the class that is stated; a structure of "NA" is null.
    """
    d = spark.read.schema(f"SERIES string, HORIZONS array<array<struct<{_LAYER.replace(' ', ':').replace(',:', ',')}>>>").option("multiLine", True).json(path)
    layers = d.select(F.col("SERIES").alias("series"), F.posexplode(F.col("HORIZONS")[0]).alias("place", "h")).select("series", "place", "h.*")
    gravel, texture = horizons("narrative")
    colour = lambda m: F.concat(f"{m}_hue", F.lit(" "), f"{m}_value", F.lit("/"), f"{m}_chroma").alias(m)
    return layers.select("series", "place", "name", "top", "bottom", colour("dry"), colour("moist"), gravel.alias("gravel"), F.coalesce(texture, "texture_class").alias("texture"), F.nullif("structure", F.lit("NA")).alias("structure"))


def section_text(content: str) -> Column:
    """Text of a document's section without its heading in capitals; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(content, r"^[A-Z ]+:\s*", "")), F.lit(""))


def box_wkt(lat: Column, lon: Column, radius_m: float) -> Column:
    """A square around a point, by half its side in metres, as closed WKT polygon to six decimals."""
    dy = F.lit(radius_m / METRES_PER_DEGREE)
    dx = dy / F.cos(F.radians(lat))
    return ring_wkt(F.array(*[F.struct((lon + i * dx).alias("x"), (lat + j * dy).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]), "POLYGON(", ")")


def ring_wkt(ring: Column, begin: str = "", end: str = "") -> Column:
    """A ring of (x, y), closed if it isn't, in brackets."""
    closed = F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(ring[0])))
    points = F.transform(closed, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"]))
    return F.concat(F.lit(begin + "("), F.array_join(points, ","), F.lit(")" + end))


def polygons_wkt(rings: Column) -> Column:
    """Rings of (x, y) as a polygon, or as a multipolygon if there are several; null for none."""
    written = F.transform(rings, lambda r: ring_wkt(r))
    several = F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(written, lambda w: F.concat(F.lit("("), w, F.lit(")"))), ","), F.lit(")"))
    return F.when(F.size(rings) == 1, F.concat(F.lit("POLYGON("), written[0], F.lit(")"))).when(F.size(rings) > 1, several)


#: Metres of a degree of latitude, on the sphere that boxes are drawn on. Fixed value.
METRES_PER_DEGREE = 111320.0


def replace_marked(text: str, begin: str, end: str, body: str) -> Column:
    """Text between a pair of markers that stands exactly once, replaced; null else."""
    pattern = f"(?s)(\\Q{begin}\\E).*?(\\Q{end}\\E)"
    quoted = body.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(F.regexp_count(text, F.lit(pattern)) == 1, F.regexp_replace(text, pattern, f"$1{quoted}$2"))


def test_summary(text: str) -> Column:
    """Tests run, failed and skipped in a unittest log."""
    number = lambda p: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract({text}, '{p}', 1), '') as int)"), F.lit(0))
    return F.struct(number("Ran ([0-9]+) test").alias("ran"), (number("failures=([0-9]+)") + number("errors=([0-9]+)")).alias("failed"), number("skipped=([0-9]+)").alias("skipped"))


def workflow_findings(lines: DataFrame) -> DataFrame:
    """(path, rule, n) of numbered workflow lines (path, n, line): actions not pinned to a commit, untrusted expressions inside run blocks, missing top-level permissions.

    A run block holds the lines after ``run:`` that are indented more than it.
    """
    w = Window.partitionBy("path").orderBy("n")
    depth = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    t = lines.withColumn("depth", depth).withColumn("run_at", F.when(F.col("line").rlike(r"^\s*(- )?run:"), F.col("n")))
    t = t.withColumn("run_at", F.last("run_at", ignorenulls=True).over(w)).withColumn("run_depth", F.when(F.col("run_at") == F.col("n"), F.col("depth")))
    t = t.withColumn("run_depth", F.last("run_depth", ignorenulls=True).over(w)).withColumn("shallow", F.max(F.when((F.col("run_at") < F.col("n")) & (F.trim("line") != "") & (F.col("depth") <= F.col("run_depth")), 1)).over(Window.partitionBy("path", "run_at").orderBy("n")))
    inside = F.col("run_at").isNotNull() & F.col("shallow").isNull()
    loose = t.where(F.col("line").rlike(r"uses:\s*\S+@") & ~F.col("line").rlike("@[0-9a-f]{40}")).select("path", F.lit("unpinned action").alias("rule"), "n")
    unsafe = t.where(inside & F.col("line").rlike(r"\$\{\{\s*github\.(event|head_ref)")).select("path", F.lit("untrusted expression").alias("rule"), "n")
    open_ = lines.groupBy("path").agg(F.bool_or(F.col("line").rlike("^permissions:")).alias("ok")).where("not ok").select("path", F.lit("no permissions").alias("rule"), F.lit(None).cast("int").alias("n"))
    return loose.unionByName(unsafe).unionByName(open_)


def script_table(text: str, name: str) -> Column:
    """Rows of an array of arrays that page source assigns to ``name``, as arrays of strings."""
    body = F.regexp_extract(text, rf"(?s)\b{name}\s*=\s*(\[\s*\[.*?\]\s*\])", 1)
    return F.from_json(F.nullif(body, F.lit("")), "array<array<string>>")


def tile_of(path: str = "path") -> Column:
    """z, x and y of a tile's path."""
    part = lambda i: F.expr(f"try_cast(nullif(regexp_extract({path}, '([0-9]+)/([0-9]+)/([0-9]+)\\\\.[a-z]+$', {i}), '') as int)")
    return F.struct(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"))


def cached(spark: SparkSession, folder: str, statement: str, run) -> DataFrame:
    """Result of a statement, kept as a table under the digest of its text: ``run`` is called only the first time."""
    import hashlib

    place = f"{folder}/{hashlib.sha256(statement.encode()).hexdigest()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        run(statement).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of files, contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def within_budget(files: DataFrame, most: int, parts: tuple[str, ...] = (), endings: tuple[str, ...] = ()) -> DataFrame:
    """Files of a listing without those in folders ``parts`` or with these endings; an error, when it is read, if they exceed ``most`` bytes together."""
    pieces = F.split("path", "/")
    out = F.exists(pieces, lambda p: p.isin(*parts)) if parts else F.lit(False)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*endings) if endings else F.lit(False)
    kept = files.where(~out & ~ending)
    total = kept.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("_total"))  # one row
    over = F.concat(F.lit(f"more than {most} bytes: "), F.col("_total"))
    return kept.join(F.broadcast(total)).where(F.when(F.col("_total") <= most, F.lit(True)).otherwise(F.raise_error(over).cast("boolean"))).drop("_total")


ITEM = "id string, bbox array<double>, properties struct<datetime:timestamp,`eo:cloud_cover`:double>, assets map<string,struct<href:string>>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(id, bbox, taken, cloud, links) of catalogue items, one JSON document a file; documents that aren't items are left out."""
    d = spark.read.schema(ITEM).json(path, multiLine=True).where("id is not null and bbox is not null")
    return d.select("id", "bbox", F.col("properties.datetime").alias("taken"), F.col("properties.`eo:cloud_cover`").alias("cloud"), F.transform_values("assets", lambda _, a: a["href"]).alias("links"))
