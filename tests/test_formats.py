"""Data sources and table functions: what a query asks for decides what is read."""

import numpy as np
import pytest
from test_sources import COVERAGE, dbf, shp, tif, tiled

from geostrata.sources import binary, formats, tables


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    tables.register(spark)
    return spark


@pytest.fixture
def raster(tmp_path):
    values = np.arange(64 * 64, dtype="uint8").reshape(64, 64) % 251
    (tmp_path / "a.tif").write_bytes(tiled(values, 16, 2))
    (tmp_path / "b.tif").write_bytes(tif(np.arange(12, dtype="float32").reshape(3, 4) - 5))
    return values, f"file://{tmp_path}"


def reader(path, **options):
    return formats.RasterSource({"path": path, "pattern": "a.tif", **options}).reader(None)


def test_a_window_reads_few_blocks(raster):
    values, path = raster
    count = lambda r: sum(len(p.blocks) for p in r.partitions())
    assert count(reader(path)) == 16 and count(reader(path, factor="2")) == 4
    r = reader(path, rows="17:30", cols="3:13")
    assert count(r) == 1
    cells = [c for p in r.partitions() for b in r.read(p) for c in b.to_pylist()]
    assert {(c["row"], c["col"]): c["value"] for c in cells} == {(i, j): float(values[i, j]) for i in range(17, 30) for j in range(3, 13)}
    assert count(reader(path, rows="5:5")) == count(reader(path, rows="64:")) == 0 and count(reader(path, rows=":16", cols="40:")) == 2


def test_a_scan_serves_several_plans(known, raster):
    values, path = raster
    load = lambda **o: known.read.format("geostrata_raster").options(pattern="a.tif", **o).load(path)
    df = load()
    part = df.where("row >= 20 and row < 22 and col in (5, 40)")
    assert {(r.row, r.col): r.value for r in part.collect()} == {(i, j): float(values[i, j]) for i in (20, 21) for j in (5, 40)}
    assert df.count() == 64 * 64 and df.where("value = 250").count() == int((values == 250).sum())
    assert df.join(part.withColumnRenamed("value", "v"), ["path", "row", "col"]).where("v = value").count() == 4
    window = load(rows="20:22", cols="5:41")
    assert window.count() == 72 and load(factor="2").count() == 32 * 32


def test_files_and_codes_of_a_raster(known, raster):
    _, path = raster
    df = known.read.format("geostrata_raster").option("nodata", "-4").load(path)
    assert df.select("path").distinct().count() == 2
    one = df.where(df.path.endswith("b.tif")).orderBy("row", "col").collect()
    assert [r.value for r in one] == [None, None, *[float(v) for v in range(-3, 7)]]
    assert known.read.format("geostrata_raster").option("pattern", "*.none").load(path).count() == 0


def test_coverages_by_kind_and_name(known, tmp_path):
    (tmp_path / "x.e00").write_text("\n".join(COVERAGE))
    read = lambda kind: known.read.format("geostrata_coverage").option("kind", kind).load(f"file://{tmp_path}")
    from geostrata.sources import coverage

    plain = lambda df: sorted(map(str, df.drop("path").collect()))
    assert plain(read("arcs")) == plain(coverage.read_arcs(known, str(tmp_path))) and read("arcs").count() > 0
    every = coverage.read_tables(known, str(tmp_path))
    name = every.first().name
    one = known.read.format("geostrata_coverage").options(kind="tables", table=name).load(f"file://{tmp_path}")
    assert plain(one) == plain(every.where(f"name = '{name}'")) and plain(read("tables")) == plain(every)


def test_table_functions_in_sql(known, tmp_path):
    d = dbf([("NAME", "C", 8, 0), ("KM", "N", 8, 2)], [("a", 1.5), ("gone", 2), ("c", 4)], deleted=(1,))
    s = shp(3, [[[(0, 0), (1, 1)], [(2, 2), (3, 3), (4, 4)]], None, [[(9, 9), (8, 8)]]])
    pixels = np.array([[[1, 2, 3], [4, 5, 6]]], np.uint8)
    files = [("d", d), ("d", None), ("none", None), ("s", s), ("p", binary.png_bytes(pixels)), ("t", tif(np.array([[1.5, -2.0]], "float32")))]
    known.createDataFrame(files, "kind string, content binary").createOrReplaceTempView("files")
    sql = lambda q: [tuple(r) for r in known.sql(q).collect()]
    got = sql("SELECT record, attributes['NAME'], CAST(attributes['KM'] AS DOUBLE) FROM (SELECT * FROM files WHERE kind = 'd') f, LATERAL dbase_rows(f.content) ORDER BY record")
    assert got == [(0, "a", 1.5), (1, None, None), (2, "c", 4.0)]
    joined = """WITH parts AS (SELECT p.* FROM (SELECT * FROM files WHERE kind = 's') f, LATERAL shape_parts(f.content) p),
      rows_ AS (SELECT r.* FROM (SELECT * FROM files WHERE kind = 'd') f, LATERAL dbase_rows(f.content) r)
      SELECT parts.record, part, CASE WHEN points IS NOT NULL THEN size(points) END, attributes['NAME'] FROM parts JOIN rows_ ON parts.record = rows_.record ORDER BY 1, 2"""
    assert sql(joined) == [(0, 0, 2, "a"), (0, 1, 3, "a"), (1, 0, None, None), (2, 0, 2, "c")]
    of = lambda kind: f"TABLE(SELECT kind AS path, content FROM files WHERE kind IN ('{kind}', 'none'))"
    assert sql(f"SELECT path, row, col, red, blue FROM png_cells({of('p')}) ORDER BY col") == [("p", 0, 0, 1, 3), ("p", 0, 1, 4, 6)]
    assert sql(f"SELECT col, value FROM tiff_cells({of('t')}) WHERE value < 0") == [(1, -2.0)]
