"""Projections on a lattice, random fields and cached tiles."""

import math
import os
import shutil

import pytest
from pyspark.sql import functions as F

from geostrata.functions import fields
from geostrata.sources import tiles


def test_a_lattice_is_exact_at_its_nodes_and_near_between(spark):
    calls = []

    def project(a, b):
        calls.append(1)
        return a * a, F.sin(b)

    rows = [(i, i * 0.37 - 3, i * 0.11 - 2) for i in range(60)] + [(100, 0.5, -0.25), (101, None, 1.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    got = {r.i: r for r in fields.on_lattice(df, "a", "b", 0.25, project).collect()}
    assert len(got) == 62 and got[101].px is None and (got[100].px, got[100].py) == (0.25, math.sin(-0.25))
    # second derivatives are 2 and at most 1, so the error is at most step^2 / 8 times that
    assert all(abs(got[i].px - a * a) <= 2 * 0.25**2 / 8 + 1e-12 and abs(got[i].py - math.sin(b)) <= 0.25**2 / 8 + 1e-12 for i, a, b in rows[:-1])
    assert len(calls) == 4  # once for each kind of corner, not for each point


def test_fields_do_not_depend_on_partitions(spark):
    df = spark.range(4000).select(F.floor(F.col("id") / 50).alias("r"), (F.col("id") % 50).alias("c"))
    made = lambda d: {(r.r, r.c): (r.v, r.n) for r in d.select("r", "c", fields.value_noise(3, F.col("r"), F.col("c"), 8.0, 3).alias("v"), fields.normal(5, F.col("r"), F.col("c")).alias("n")).collect()}
    one = made(df)
    assert made(df.repartition(7).where("c % 3 = 1")) == {k: v for k, v in one.items() if k[1] % 3 == 1}
    n = [v[1] for v in one.values()]
    mean = sum(n) / len(n)
    spread = math.sqrt(sum((x - mean) ** 2 for x in n) / len(n))
    assert abs(mean) < 0.06 and abs(spread - 1) < 0.05 and len(set(n)) == len(n)
    assert all(0 < v < 1 for v, _ in one.values())
    assert max(abs(one[r, c][0] - one[r, c + 1][0]) for r, c in one if c < 49) < 0.5  # neighbours are near


def test_smooth_noise_is_its_nodes_at_nodes(spark):
    df = spark.createDataFrame([(0, 0), (8, 16), (-8, 8)], "r int, c int")
    got = df.select(fields.value_noise(3, F.col("r"), F.col("c"), 8.0).alias("v"), fields.drawn(3, F.floor(F.col("r") / 8), F.floor(F.col("c") / 8)).alias("w")).collect()
    assert all(r.v == r.w for r in got)


def test_a_second_scan_reads_nothing_from_the_source(spark, tmp_path):
    source, cache = tmp_path / "source", str(tmp_path / "cache")
    wanted = [(3, x, y) for x in range(4) for y in range(5)]
    for z, x, y in wanted:
        (source / str(z) / str(x)).mkdir(parents=True, exist_ok=True)
        (source / str(z) / str(x) / f"{y}.png").write_bytes(bytes([z, x, y]))
    df = spark.createDataFrame(wanted + wanted[:3] + [(None, 1, 1)], "z int, x int, y int").repartition(3)
    fetch = tiles.from_store(f"{source}/{{z}}/{{x}}/{{y}}.png")
    first = tiles.read_tiles(df.where("x < 3"), cache, fetch).collect()
    assert sorted((r.z, r.x, r.y, bytes(r.content)) for r in first) == sorted((z, x, y, bytes([z, x, y])) for z, x, y in wanted if x < 3) and not any(r.cached for r in first)
    again = tiles.read_tiles(df, cache, fetch).collect()
    assert len(again) == 20 and all(r.cached == (r.x < 3) for r in again)
    shutil.rmtree(source)
    for how in (fetch, None):  # offline as well
        got = tiles.read_tiles(df, cache, how).collect()
        assert len(got) == 20 and all(r.cached for r in got)
    os.remove(f"{cache}/3/2/4.png")
    with pytest.raises(Exception, match="3/2/4"):
        tiles.read_tiles(df, cache, None).collect()
