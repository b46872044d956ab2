"""Decoders on bytes that the tests build by the published formats."""

import base64
import hashlib
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.functions import expressions as E
from geostrata.sources import binary as B
from geostrata.sources import coverage, grids, text
from geostrata.sources import tiff as T


def dbf(fields, rows, deleted=()):
    head = struct.pack("<BBBBIHH20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(fields), 1 + sum(f[2] for f in fields))
    body = b"".join(struct.pack("11sc4xBB14x", n.encode(), k.encode(), w, d) for n, k, w, d in fields) + b"\r"
    for i, r in enumerate(rows):
        body += (b"*" if i in deleted else b" ") + b"".join(str(v).encode().ljust(f[2]) for v, f in zip(r, fields, strict=True))
    return head + body


def shp(kind, records):
    body = b""
    for i, parts in enumerate(records):
        if parts is None:
            shape = struct.pack("<I", 0)
        else:
            pts = [p for part in parts for p in part]
            starts = np.cumsum([0] + [len(p) for p in parts])[:-1].tolist()
            shape = struct.pack("<I4dII", kind, 0, 0, 1, 1, len(parts), len(pts)) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">II", i + 1, len(shape) // 2) + shape
    return struct.pack(">I20xI", 9994, 50 + len(body) // 2) + struct.pack("<II8d", 1000, kind, *[0.0] * 8) + body


def test_dbase_and_shapes_meet_by_record(spark, tmp_path):
    d = dbf([("NAME", "C", 8, 0), ("KM", "N", 8, 2)], [("a", 1.5), ("", ""), ("gone", 2)], deleted=(2,))
    assert B.dbase(d) == [{"NAME": "a", "KM": 1.5}, {"NAME": None, "KM": None}, None]
    s = shp(3, [[[(0, 0), (1, 1)], [(2, 2), (3, 3), (4, 4)]], None, [[(9, 9), (8, 8)]]])
    assert B.shapes(s)[1] is None and [len(p) for p in B.shapes(s)[0]] == [2, 3]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("Lines.DBF", d)
        z.writestr("Lines.SHP", s)
    rows = B.read_features(spark, str(tmp_path / "x.zip")).collect()
    assert [(r.record, r.attributes["NAME"], len(r.parts)) for r in rows] == [(0, "a", 2)]


def test_png_round_trip_and_filters(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (B.png(B.png_bytes(pixels)) == pixels).all()
    # every filter, by its definition
    raw = b""
    for y in range(5):
        line = []
        for i in range(15):
            v = int(pixels[y].ravel()[i])
            left = int(pixels[y].ravel()[i - 3]) if i >= 3 else 0
            up = int(pixels[y - 1].ravel()[i]) if y else 0
            corner = int(pixels[y - 1].ravel()[i - 3]) if y and i >= 3 else 0
            p = left + up - corner
            near = sorted([(abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)])[0][2]
            line.append((v - (0, left, up, (left + up) // 2, near)[y]) % 256)
        raw += bytes([y, *line])
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (B.png(data) == pixels[:5]).all()
    (tmp_path / "t.png").write_bytes(B.png_bytes(np.array([[[128, 0, 0], [133, 37, 128], [127, 246, 0]]], np.uint8)))
    assert [r.height for r in B.read_heights(spark, str(tmp_path)).orderBy("col").collect()] == [0.0, 1317.5, -10.0]


def tif(values, order="<", compress=None, predictor=1):
    h, w = values.shape
    raw = values
    if predictor == 2:
        raw = np.diff(values, axis=1, prepend=values[:, :1] * 0)
    raw = raw.astype(values.dtype.newbyteorder(order)).tobytes()
    packing = 1
    if compress:
        raw, packing = compress(raw), 8 if compress is zlib.compress else 5
    bits, form = values.dtype.itemsize * 8, {"f": 3, "u": 1}[values.dtype.kind]
    tags = [(256, 3, w), (257, 3, h), (258, 3, bits), (259, 3, packing), (273, 4, 8), (277, 3, 1), (278, 3, h), (279, 4, len(raw)), (317, 3, predictor), (339, 3, form)]
    at = 8 + len(raw)
    out = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at) + raw + struct.pack(order + "H", len(tags))
    for t, k, v in tags:
        out += struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v))
    return out + b"\0\0\0\0"


def lzw_pack(data):
    """An LZW stream that only uses a table until it is full enough, by the TIFF rules."""
    table, codes, word = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
    width = lambda: max(9, min(12, (max(table.values(), default=257) + 2 if len(table) > 256 else 258).bit_length()))
    nxt = 258
    for b in data:
        b = bytes([b])
        if word + b in table:
            word += b
            continue
        codes.append((table[word], max(9, nxt.bit_length() if nxt > 511 else 9)))
        table[word + b] = nxt
        nxt += 1
        if nxt == 4094:
            codes.append((256, 12))
            table, nxt = {bytes([i]): i for i in range(256)}, 258
        word = b
    codes += [(table[word], max(9, nxt.bit_length())), (257, max(9, (nxt + 1).bit_length()))]
    bits = "".join(f"{c:0{n}b}" for c, n in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_tiff_forms(spark, tmp_path):
    v = np.arange(12, dtype="float32").reshape(3, 4) - 5
    for order in "<>":
        assert (T.tiff(tif(v, order)) == v).all()
    u = np.arange(200, dtype="uint8").reshape(10, 20)
    assert (T.tiff(tif(u, compress=zlib.compress, predictor=2)) == u).all()
    short = bytes(range(40)) * 3
    assert T.lzw(lzw_pack(short)) == short
    v[0, 0] = -9999
    (tmp_path / "a.tif").write_bytes(tif(v))
    rows = T.read_raster(spark, str(tmp_path), -9000).orderBy("row", "col").collect()
    assert rows[0].value is None and rows[-1].value == 6.0 and len(rows) == 12


def tiled(values, side, levels=1):
    """A TIFF of deflated tiles with overviews that keep every second cell."""
    body, heads, images = b"", [], [values[:: 2**k, :: 2**k] for k in range(levels)]
    for v in images:
        h, w = v.shape
        padded = np.pad(v, ((0, -h % side), (0, -w % side)))
        tiles = [zlib.compress(padded[r : r + side, c : c + side].astype("<u2").tobytes()) for r in range(0, h, side) for c in range(0, w, side)]
        starts = np.cumsum([8 + len(body)] + [len(t) for t in tiles])[:-1].tolist()
        body += b"".join(tiles)
        heads.append((w, h, starts, [len(t) for t in tiles]))
    out, at = body, 8 + len(body)
    for k, (w, h, starts, sizes) in enumerate(heads):
        n = len(starts)
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 4, 1, 16), (259, 4, 1, 8), (322, 4, 1, side), (323, 4, 1, side), (324, 4, n, starts), (325, 4, n, sizes)]
        lists = at + 2 + 12 * len(tags) + 4
        extra, entries = b"", b""
        for tag, kind, count, v in tags:
            if count > 1:
                v, extra = lists + len(extra), extra + struct.pack(f"<{count}I", *v)
            entries += struct.pack("<HHII", tag, kind, count, v if isinstance(v, int) else v[0])
        following = lists + len(extra) if k + 1 < levels else 0
        out += struct.pack("<H", len(tags)) + entries + struct.pack("<I", following) + extra
        at = lists + len(extra)
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + out


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        got = super().read(n)
        self.read_bytes += len(got)
        return got


def test_windows_and_overviews_read_few_blocks(spark, tmp_path):
    v = np.random.default_rng(3).integers(0, 60000, (300, 260)).astype("uint16")
    data = tiled(v, 64, 3)
    f = Counting(data)
    images = T.directories(f)
    assert [(m.width, m.height) for m in images] == [(260, 300), (130, 150), (65, 75)] and f.read_bytes < 2000
    assert [T.overview(images, x) for x in (0.5, 1, 1.9, 2, 3.9, 4, 99)] == [0, 0, 0, 1, 1, 2, 2]
    assert (T.window(f, images[0], 60, 100, 20, 30) == v[60:80, 100:130]).all() and f.read_bytes < len(data) / 4
    assert (T.window(f, images[0], -5, 250, 10, 50) == v[:5, 250:]).all() and T.window(f, images[0], 300, 0, 5, 5).size == 0
    assert (T.tiff(data) == v).all() and (T.tiff(data, 1) == v[::2, ::2]).all()
    (tmp_path / "a b.tif").write_bytes(data)
    rows = T.read_raster(spark, str(tmp_path)).collect()
    assert len(rows) == v.size and {(r.row, r.col): r.value for r in rows} == {(i, j): float(v[i, j]) for i in range(300) for j in range(260)}
    part = T.read_raster(spark, str(tmp_path), factor=2, box=(10, 20, 3, 4)).collect()
    assert {(r.row, r.col): r.value for r in part} == {(i, j): float(v[2 * i, 2 * j]) for i in range(10, 13) for j in range(20, 24)}
    assert T.blocks_of(spark, str(tmp_path), 1.0, (0, 0, 1, 1)).count() == 1


def ten(*numbers):
    return "".join(f"{x:10d}" for x in numbers)


def item(name, size, place, kind):
    return f"{name:16s}{size:3d}{'':15s}{kind * 10:3d}{'':28s}{place:4d}-"


COVERAGE = [
    "EXP  0 X", "ARC  2", ten(1, 7, 1, 2, 2, 3, 3), " 0.0000000E+00 0.0000000E+00-1.0000000E+01 0.0000000E+00",
    " 1.0000000E+01 5.0000000E+00", ten(-1, 0, 0, 0, 0, 0, 0),
    "PRJ  2", "Units METERS", "EOP",
    "IFO  2", f"{'X.PAT':32s}XX{4:4d}{4:4d}{92:4d}{3:10d}", item("AREA", 4, 1, 6), item("X-ID", 4, 2, 5), item("OLD", 4, -1, 2), item("PTYPE", 70, 3, 2),
    f"{-1.5:14.7E}{0:11d}", "", f"{2.5:14.7E}{9:11d}Qa alluvium", "", f"{3.5:14.7E}{8:11d}Kf", "", f"{'X.AAT':32s}XX{1:4d}{1:4d}{4:4d}{0:10d}", item("K", 4, 1, 5), "EOI", "EOS",
]


def test_coverage(spark, tmp_path):
    (tmp_path / "x.e00").write_text("\n".join(COVERAGE))
    (tmp_path / "y.e00").write_text("\n".join(COVERAGE))
    a = coverage.read_arcs(spark, str(tmp_path)).collect()
    assert [(r.arc_id, r.lpoly, r.rpoly, [tuple(p) for p in r.pts]) for r in a] == [(7, 2, 3, [(0.0, 0.0), (-10.0, 0.0), (10.0, 5.0)])] * 2
    t = coverage.read_tables(spark, str(tmp_path / "x.e00")).orderBy("record").collect()
    assert [(r.name, r.record, r.attributes["PTYPE"], r.attributes["X-ID"]) for r in t] == [("X.PAT", 1, "", "0"), ("X.PAT", 2, "Qa alluvium", "9"), ("X.PAT", 3, "Kf", "8")]
    assert set(t[0].attributes) == {"AREA", "X-ID", "PTYPE"} and float(t[1].attributes["AREA"]) == 2.5
    assert [(r.left, r.right) for r in coverage.labelled_arcs(spark, str(tmp_path), "PTYPE").collect()] == [("Qa alluvium", "Kf")] * 2
    double = ["EXP  0 X", "ARC  3", ten(1, 1, 1, 1, 1, 2, 2), f"{1.5:21.14E}{-2.5:21.14E}", f"{3.0:21.14E}{4.0:21.14E}", ten(-1, 0, 0, 0, 0, 0, 0)]
    assert coverage.arc_rows("\n".join(double).encode())["pts"][0] == [{"x": 1.5, "y": -2.5}, {"x": 3.0, "y": 4.0}]
    for wrong in (b"nothing", b"EXP  1 X\nARC  2\n", b"EXP  0 X\nPRJ  2\nEOP\n", b""):
        with pytest.raises(ValueError):
            coverage.arc_rows(wrong)


def test_palette_and_differences(spark):
    pixels = np.random.default_rng(2).integers(0, 3, (6, 9)).astype(np.uint8)
    colours = [(0, 0, 0, 0), (10, 20, 30, 255), (1, 2, 3, 128)]
    data = B.png_bytes(pixels, colours)
    assert (B.png(data)[..., 0] == pixels).all() and b"PLTE" + bytes([0, 0, 0, 10, 20, 30, 1, 2, 3]) in data and b"tRNS" + bytes([0, 255, 128]) in data
    for shape in ((5, 7), (5, 7, 3), (0, 4), (3, 1, 4)):
        some = np.random.default_rng(4).integers(0, 256, shape).astype(np.uint8)
        assert (B.png(B.png_bytes(some, sub=True)).reshape(shape) == some).all()
    with pytest.raises(ValueError):
        B.png_bytes(pixels, colours[:1])
    cells = spark.createDataFrame([("a", 0, 1, 7), ("a", 1, 0, 9), ("b", 0, 0, 1), ("b", None, 0, 1)], "tile string, row int, col int, value int")
    got = {r.tile: B.png(bytes(r.png))[..., 0].tolist() for r in B.image_files(cells, "tile", sub=True).collect()}
    assert got == {"a": [[0, 7], [9, 0]], "b": [[1]]}


def test_bundles(spark):
    d = spark.createDataFrame([([1, 2, -300, 30000],), ([5],), (None,)], "v array<int>").select("v", B.bundle(E.to_planes("v")).alias("t"))
    back = d.select("v", B.unbundle(F.col("t")).alias("p"))
    assert [(r.v, r.w) for r in back.select("v", E.from_planes("p").alias("w")).collect()] == [(r.v, r.v) for r in d.collect()]


def test_files_as_tables(spark, tmp_path):
    for name, body in {"a/x.js": "const T = [[\"p\", 1], [\"q\", 2.5]];", "a/y.bin": "12345", "skip/z.js": "0123456789", "a/w.MP4": "123"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    files = text.listing(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in files.collect()) == [("w.MP4", 3), ("x.js", 33), ("y.bin", 5), ("z.js", 10)]
    assert text.listing(spark, str(tmp_path), "*.js").count() == 2
    kept = text.within_budget(files, 38, ("skip",), (".mp4",))
    assert sorted(r.length for r in kept.collect()) == [5, 33]
    with pytest.raises(Exception, match="more than 37 bytes: 38"):
        text.within_budget(files, 37, ("skip",), (".mp4",)).collect()
    src = spark.read.text(str(tmp_path / "a/x.js"), wholetext=True)
    assert src.select(text.script_table("value", "T").alias("t"), text.script_table("value", "U").alias("u")).first() == ([["p", "1"], ["q", "2.5"]], None)
    sums = B.checksums(spark, str(tmp_path / "a/y.bin")).first()
    assert (sums.bytes, sums.sha256) == (5, hashlib.sha256(b"12345").hexdigest())
    assert sums.integrity == "sha384-" + base64.b64encode(hashlib.sha384(b"12345").digest()).decode()
    tiles = spark.createDataFrame([("s3://x/7/12/45.png",), ("nothing",)], "path string")
    assert [tuple(r.t) for r in tiles.select(text.tile_of().alias("t")).collect()] == [(7, 12, 45), (None, None, None)]
    np.array([[1, -32768, 3], [4, 5, 6]], "<i2").tofile(tmp_path / "g.dat")
    grid = B.read_grid(spark, str(tmp_path / "g.dat"), 3, nodata=-32768).orderBy("row", "col").collect()
    assert [r.value for r in grid] == [1.0, None, 3.0, 4.0, 5.0, 6.0]


def test_results_are_kept_by_their_statement(spark, tmp_path):
    asked = []

    def ask(statement):
        asked.append(statement)
        return spark.sql(statement)

    for _ in range(2):
        assert text.cached(spark, str(tmp_path), "select 1 as a", ask).collect()[0].a == 1
    assert text.cached(spark, str(tmp_path), "select 2 as a", ask).collect()[0].a == 2 and asked == ["select 1 as a", "select 2 as a"]


def test_catalogue_items(spark, tmp_path):
    good = {"id": "s1", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-05-01T10:00:00Z", "eo:cloud_cover": 3.5}, "assets": {"red": {"href": "r.tif"}}, "more": 1}
    for name, body in {"a.json": json.dumps(good, indent=1), "b.json": "{}", "c.json": "not json", "d.json": json.dumps({"id": "s2", "bbox": [0, 0, 1, 1]})}.items():
        (tmp_path / name).write_text(body)
    got = sorted((r.id, list(r.bbox), r.cloud, r.links) for r in text.read_items(spark, str(tmp_path)).collect())
    assert got == [("s1", [1.0, 2.0, 3.0, 4.0], 3.5, {"red": "r.tif"}), ("s2", [0.0, 0.0, 1.0, 1.0], None, None)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features":[{"properties":{"id":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"properties":{"id":"y"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0,5],[1,0,5],[1,1,5],[0,0,5]]],[[[2,2],[3,2],[3,3],[2,2]]]]}}]}')
    got = {r.props["id"]: len(r.rings) for r in text.read_geojson(spark, str(tmp_path)).collect()}
    assert got == {"x": 1, "y": 2}
    w = spark.createDataFrame([("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0), (2 2, 3 2, 3 3, 2 2)), ((5 5, 6 5, 6 6, 5 5)))",), ("POINT (1 1)",), (None,)], "w string")
    assert [len(r.r) for r in w.select(text.wkt_rings("w").alias("r")).collect()] == [3, 0, 0]
    rot = spark.createDataFrame(enumerate(["1 0.0 0 0 0 9 !start", "1 5.0 10 20 3 9", "! note", "999 0 0 0 0 9", "2 1 1 1 1 2", "1 9.0 1 1 1 8"]), "n long, line string")
    assert [(r.plate, r.age, r.sequence) for r in text.rotations(rot).orderBy("n").collect()] == [(1, 0.0, 1), (1, 5.0, 1), (1, 9.0, 2)]
    t = spark.createDataFrame([("Enumerated_Domain_Value: Qa\nEnumerated_Domain_Value_Definition: alluvium\nEnumerated_Domain_Value: Kf\nEnumerated_Domain_Value_Definition: \nEnumerated_Domain_Value: Qa\nEnumerated_Domain_Value_Definition: later",)], "t string")
    assert t.select(text.unit_names("t").alias("m")).first().m == {"Qa": "alluvium"}
    ids = spark.createDataFrame([("| id | x |\n|---|---|\n| `a-1` | y |\n| `b` | z |",)], "t string").select(text.ledger_ids("t").alias("i")).first().i
    assert ids == ["a-1", "b"]
    h = spark.createDataFrame([("brown; gravelly loam; 15 percent gravel",), ("grey",)], "d string").select(*[c.alias(n) for c, n in zip(text.horizons("d"), "gt", strict=True)]).collect()
    assert [(r.g, r.t) for r in h] == [(15, "gravelly loam"), (None, None)]
    m = spark.createDataFrame([("a /*b*/ old /*e*/ z",), ("none",)], "t string").select(text.replace_marked("t", "/*b*/", "/*e*/", " new$1 ").alias("m")).collect()
    assert [r.m for r in m] == ["a /*b*/ new$1 /*e*/ z", None]
    s = spark.createDataFrame([("Ran 12 tests in 3s\nFAILED (failures=2, errors=1, skipped=4)",)], "t string").select(text.test_summary("t").alias("s")).first().s
    assert tuple(s) == (12, 3, 4)
    flow = ["on: push", "jobs:", "  - uses: a/b@v1", "  - uses: a/b@" + "a" * 40, "  - run: |", "      echo ${{ github.event.issue.title }}", "  - name: ${{ github.event.x }}"]
    f = text.workflow_findings(spark.createDataFrame([("p", i, x) for i, x in enumerate(flow)], "path string, n int, line string")).collect()
    assert sorted((r.rule, r.n) for r in f if r.n is not None) == [("unpinned action", 2), ("untrusted expression", 5)] and sum(r.rule == "no permissions" for r in f) == 1


def test_member_ignores_case():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("d/A.TXT", "x")
    assert B.member(b.getvalue(), ".txt") == b"x"


def test_json_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.5, 2.5])], "id int, n string, v array<double>")
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(str(tmp_path / "o"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "o")).collect() == df.collect()


def test_grids_come_back_with_their_sidecars(spark, tmp_path):
    rows = [("a", r, c, None if (r, c) == (1, 2) else r * 0.5 - c) for r in range(3) for c in range(4)] + [("b", 0, 0, 7.0), ("c", 2, 3, None)]
    cells = spark.createDataFrame(rows, "tile string, row long, col long, value double")
    made = grids.write_grids(cells, "tile", str(tmp_path / "g"), 4, 3, 10.0, 500.0, 900.0, scale=0.5).orderBy("key").collect()
    assert [(r.key, r.low, r.high, r.missing) for r in made] == [("a", -3.0, 1.0, 1), ("b", 7.0, 7.0, 11), ("c", None, None, 12)]
    assert all(hashlib.sha256((tmp_path / "g" / f"{r.key}.bin").read_bytes()).hexdigest() == r.sha256 for r in made)
    assert sorted(p.name for p in (tmp_path / "g").iterdir()) == ["a.bin", "a.json", "b.bin", "b.json", "c.bin", "c.json"]
    back = grids.read_grids(spark, str(tmp_path / "g"))
    assert back.count() == 36
    got = {(r.row, r.col): (r.x, r.y, r.value) for r in back.where("path like '%/a.bin'").collect()}
    assert got == {(r, c): (505.0 + 10 * c, 895.0 - 10 * r, v) for t, r, c, v in rows if t == "a"}
    (tmp_path / "g" / "b.bin").write_bytes(b"12")
    with pytest.raises(Exception, match="its sidecar states"):
        back.count()
    for bad in ([("a", 3, 0, 1.0)], [("a", 0, 0, 1e6)], [("a", 0, 0, 1.0), ("a", 0, 0, 2.0)], [("../a", 0, 0, 1.0)]):
        with pytest.raises(Exception, match="grid|two values|name a file"):
            grids.write_grids(spark.createDataFrame(bad, cells.schema), "tile", str(tmp_path / "h"), 4, 3, 10.0, 0.0, 0.0).count()
    assert grids.write_grids(cells.where("1 = 0"), "tile", str(tmp_path / "h"), 4, 3, 10.0, 0.0, 0.0).count() == 0


def test_a_grid_is_read_by_bands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grids, "CELLS", 10)
    np.arange(28, dtype="<i2").tofile(tmp_path / "g.bin")
    (tmp_path / "g.json").write_text('{"cols": 4, "rows": 7}')
    back = grids.read_grids(spark, str(tmp_path)).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.x, r.value) for r in back] == [(i // 4, i % 4, None, float(i)) for i in range(28)]


def test_a_tree_is_copied_if_it_fits(spark, tmp_path):
    for name, size in (("a.txt", 10), ("b/c.txt", 20), ("b/raw/d.txt", 1000)):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(b"x" * size)
    files = text.listing(spark, str(tmp_path / "t"))
    with pytest.raises(Exception, match="more than 500 bytes"):
        grids.copy_files(text.within_budget(files, 500), str(tmp_path / "t"), str(tmp_path / "u")).count()
    assert not (tmp_path / "u").exists()
    made = grids.copy_files(text.within_budget(files, 500, ("raw",)), str(tmp_path / "t"), str(tmp_path / "u")).collect()
    assert sorted((r.path, r.length) for r in made) == [(str(tmp_path / "u/a.txt"), 10), (str(tmp_path / "u/b/c.txt"), 20)]
    assert (tmp_path / "u/b/c.txt").read_bytes() == b"x" * 20


def test_series_documents_and_wkt(spark, tmp_path):
    layer = {"name": "A1", "top": 0, "bottom": 20, "texture_class": "loam", "narrative": "brown (10YR 5/3); gravelly sandy loam; about 20 percent gravel", "structure": "NA", "dry_hue": "10YR", "dry_value": 5, "dry_chroma": 3}
    (tmp_path / "X.json").write_text(json.dumps({"SERIES": "BALE", "HORIZONS": [[layer, {**layer, "name": "C", "narrative": None, "structure": "massive"}]]}))
    got = text.read_series(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.series, r.place, r.name, r.top, r.bottom, r.dry, r.gravel, r.texture, r.structure) for r in got] == [
        ("BALE", 0, "A1", 0, 20, "10YR 5/3", 20, "gravelly sandy loam", None),
        ("BALE", 1, "C", 0, 20, "10YR 5/3", None, "loam", "massive"),
    ]
    square = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 2.0}]
    df = spark.createDataFrame([([square],), ([square, [*square, square[0]]],), ([],)], "rings array<array<struct<x: double, y: double>>>")
    ring = "0.000000 0.000000,1.000000 0.000000,1.000000 2.000000,0.000000 0.000000"
    assert [r[0] for r in df.select(text.polygons_wkt(F.col("rings"))).collect()] == [f"POLYGON(({ring}))", f"MULTIPOLYGON((({ring})),(({ring})))", None]
    box = spark.range(1).select(text.box_wkt(F.lit(0.0), F.lit(10.0), 1113.2), text.section_text(F.lit("RANGE IN USE: vines")), text.section_text(F.lit("EMPTY: "))).first()
    assert box[0] == "POLYGON((9.990000 -0.010000,10.010000 -0.010000,10.010000 0.010000,9.990000 0.010000,9.990000 -0.010000))" and box[1:] == ("vines", None)


def test_png_rules_against_the_plain_form():
    rng = np.random.default_rng(0)
    for h, w, c in ((7, 5, 3), (1, 9, 1), (9, 1, 4), (30, 20, 2)):
        stored, rules = rng.integers(0, 256, (h, w, c)), rng.integers(0, 5, h)
        want = np.zeros((h + 1, w + 1, c), int)
        for y in range(h):
            for x in range(w):
                for k in range(c):
                    left, up, corner = int(want[y + 1, x, k]), int(want[y, x + 1, k]), int(want[y, x, k])
                    p = left + up - corner
                    near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    want[y + 1, x + 1, k] = (int(stored[y, x, k]) + (0, left, up, (left + up) // 2, near)[rules[y]]) % 256
        assert (B.unfiltered(rules.astype(np.uint8), stored.astype(np.uint8)) == want[1:, 1:]).all()
