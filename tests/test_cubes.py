"""The ledger of units and the packed years of a stream."""

import datetime as dt
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.streaming import cubes, ledger

SCHEMA = "variable string, day date, cell int, revision long, value double"
VARS, CELLS = ["tmax", "tmin"], 3


def day(y, n):
    return dt.date(y, 1, 1) + dt.timedelta(n)


def plain(units):
    """Bytes of each year by the latest revision of every unit."""
    best = {}
    for v, d, c, r, x in units:
        if (v, d, c) not in best or best[v, d, c][0] < r:
            best[v, d, c] = (r, x)
    out = {}
    for (v, d, c), (_, x) in best.items():
        codes = out.setdefault(d.year, np.full((len(VARS), cubes.days_of(d.year), CELLS), -32768, "<i2"))
        if x is not None and x == x:
            codes[VARS.index(v), d.timetuple().tm_yday - 1, c] = max(-32767, min(32767, round(x * 10)))
    return {y: c.tobytes() for y, c in out.items()}


def stored(root):
    index = cubes.index_of(root)
    out = {}
    for y, entry in index["years"].items():
        with open(f"{root}/{entry['file']}", "rb") as f:
            out[int(y)] = f.read()
        assert hashlib.sha256(out[int(y)]).hexdigest() == entry["sha256"]
    return index, out


FIRST = [("tmax", day(2023, 364), 0, 1, 12.34), ("tmin", day(2024, 365), 2, 1, -3.25), ("tmax", day(2024, 0), 1, 1, 9999.0), ("tmax", day(2024, 59), 1, 1, None), ("tmin", day(2024, 59), 0, 1, float("nan"))]
SECOND = [("tmax", day(2024, 0), 1, 2, 5.05), ("tmin", day(2024, 365), 2, 0, 77.0), ("tmin", day(2025, 3), 1, 5, 0.25)]


def test_years_are_packed_and_packed_anew(spark, tmp_path):
    root = str(tmp_path)
    cubes.merge(spark.createDataFrame(FIRST, SCHEMA).repartition(3), 0, root, VARS, CELLS)
    index, files = stored(root)
    assert files == plain(FIRST) and index["years"]["2024"]["days_with_data"] == 2 and index["last_day"] == "2024-12-31"
    before = index["years"]["2023"]
    cubes.merge(spark.createDataFrame(SECOND, SCHEMA), 1, root, VARS, CELLS)
    index, files = stored(root)
    assert files == plain(FIRST + SECOND) and index["years"]["2023"] == before  # no touched year
    cubes.merge(spark.createDataFrame(SECOND, SCHEMA).where("1 = 0"), 2, root, VARS, CELLS)
    cubes.merge(spark.createDataFrame([("tmax", day(2024, 0), 1, 9, 1.0)], SCHEMA), 1, root, VARS, CELLS)  # an old batch again
    index, again = stored(root)
    assert again == files and index["batch"] == 2 and not os.path.exists(f"{root}/daily/2024-0.bin")


def test_a_crash_between_two_files_leaves_the_cube_whole(spark, tmp_path):
    root, calm = str(tmp_path / "a"), str(tmp_path / "b")
    for r in (root, calm):
        cubes.merge(spark.createDataFrame(FIRST, SCHEMA), 0, r, VARS, CELLS)
    old = stored(root)
    os.makedirs(f"{root}/daily/2025-1.bin/in-the-way")  # the second file of the batch can't be put in place
    with pytest.raises(Exception):
        cubes.merge(spark.createDataFrame(SECOND, SCHEMA), 1, root, VARS, CELLS)
    assert stored(root) == old
    os.removedirs(f"{root}/daily/2025-1.bin/in-the-way")
    for r in (root, calm):
        cubes.merge(spark.createDataFrame(SECOND, SCHEMA), 1, r, VARS, CELLS)
    assert stored(root) == stored(calm) and stored(root)[1] == plain(FIRST + SECOND)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_a_stream_keeps_the_cube(spark, tmp_path):
    root = str(tmp_path / "cube")
    for rows in (FIRST, SECOND):
        feed(spark, str(tmp_path / "in"), rows)
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        cubes.ingest_years(stream, root, str(tmp_path / "c"), VARS, CELLS).awaitTermination()
    assert stored(root)[1] == plain(FIRST + SECOND)


def entries(spark, tmp_path, **kw):
    stream = ledger.prepared(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    unit = F.concat_ws("/", "variable", "day", "cell")
    got = ledger.units(stream, unit, F.col("revision"), F.col("value"), **kw)
    ledger.run(got, lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/taken/batch={i}"), str(tmp_path / "side"), str(tmp_path / "c")).awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / name)) if os.path.exists(tmp_path / name) else None
    return read("taken"), read("side")


def test_units_fail_wait_and_are_blocked(spark, tmp_path):
    bad, good, late = ("tmax", day(2024, 5), 0), ("tmax", day(2024, 6), 0), ("tmin", day(2020, 1), 1)
    feed(spark, str(tmp_path / "in"), [(*good, 1, 1.0), (*bad, 1, None), (*good, 1, 1.0)])
    taken, side = entries(spark, tmp_path, most=3, wait_ms=1)
    assert [(r.unit, r.revision, r.value) for r in taken.collect()] == [("tmax/2024-01-07/0", 1, 1.0)]
    assert [(r.unit, r.status, r.attempts, r.reason) for r in side.where("status = 'failed'").collect()] == [("tmax/2024-01-06/0", "failed", 1, "no value")]
    # the query starts anew each time: its ledger comes from the checkpoint; a late unit is taken, an old revision isn't
    feed(spark, str(tmp_path / "in"), [(*late, 1, 4.0)])
    _, side = entries(spark, tmp_path, most=3, wait_ms=1)
    assert [(r.unit, r.attempts) for r in side.where("status = 'due'").collect()] == [("tmax/2024-01-06/0", 1)]
    feed(spark, str(tmp_path / "in"), [(*good, 1, 1.0), (*good, 2, 2.0), (*bad, 2, float("inf"))])
    feed(spark, str(tmp_path / "in"), [(*bad, 3, None), (*late, 0, 9.0)])
    feed(spark, str(tmp_path / "in"), [(*bad, 4, 5.0)])
    taken, side = entries(spark, tmp_path, most=3, wait_ms=1)
    assert sorted((r.unit, r.revision) for r in taken.collect()) == [("tmax/2024-01-07/0", 1), ("tmax/2024-01-07/0", 2), ("tmin/2020-01-02/1", 1)]
    told = side.where("unit = 'tmax/2024-01-06/0' and status in ('failed', 'blocked')").orderBy("attempts").collect()
    assert [(r.status, r.attempts) for r in told] == [("failed", 1), ("failed", 2), ("blocked", 3)] and told[1].reason == "value inf"


def test_entries_leave_the_ledger(spark, tmp_path):
    one = ("tmax", day(2024, 6), 0)
    for _ in range(2):
        feed(spark, str(tmp_path / "in"), [(*one, 1, 1.0)])
        taken, _ = entries(spark, tmp_path, keep_ms=1)
    assert taken.count() == 2  # forgotten in between, so taken again
