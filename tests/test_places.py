"""Basins, crossings and overlaps against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from geostrata.operators import graph, spatial
from geostrata.operators.flood import flood, pools
from geostrata.operators.relational import best_overlap


def filled(cells):
    """First cell of each cell's pool, by a queue."""
    label, left = {}, set(cells)
    for start in sorted(cells):
        pool = [start] if start in left else []
        left.discard(start)
        for r, c in pool:
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.discard(n)
                    pool.append(n)
        for cell in pool:
            label[cell] = start
    return label


def spiral(n):
    """A path that winds from the corner to the middle, with walls between its turns."""
    cells, r, c, dr, dc = {(0, 0)}, 0, 0, 0, 1
    free = lambda r, c: 0 <= r < n and 0 <= c < n and (r, c) not in cells
    while True:
        for _ in range(2):
            ahead = free(r + dr, c + dc) and (r + 2 * dr, c + 2 * dc) not in cells
            if ahead:
                break
            dr, dc = dc, -dr
        if not ahead:
            return cells
        r, c = r + dr, c + dc
        cells.add((r, c))


@pytest.mark.parametrize("tile", [7, 16, 256])
def test_pools_of_a_spiral_and_of_noise(spark, tile):
    rng = random.Random(3)
    wound = spiral(64)
    noise = {(r, c) for r in range(64) for c in range(64) if rng.random() < 0.58}
    for cells in (wound, noise):
        df = spark.createDataFrame([*cells, next(iter(cells))], "row int, col int")  # one cell twice
        got = {(r.row, r.col): (r.pool >> 32, r.pool & 0xFFFFFFFF) for r in pools(df, tile).collect()}
        assert got == filled(cells)
    assert len(set(filled(wound).values())) == 1 and len(wound) > 1500


def test_flood_from_seeds_with_a_threshold(spark):
    cells = {(r, 0) for r in range(4)} | {(r, 3) for r in range(5)} | {(0, 6)} | {(r, 9) for r in range(3)}
    df = spark.createDataFrame(list(cells), "row int, col int")
    seeds = spark.createDataFrame([(0, 0, 2), (3, 0, 1), (50, 50, 4)], "row int, col int, basin int")
    got = {(r.row, r.col): r.basin for r in flood(df, seeds, least=3, tile=2).collect()}
    assert got == {(r, c): {0: 1, 3: 3, 6: 0, 9: 0}[c] for r, c in cells}
    assert flood(df.where("row < 0"), seeds).count() == 0


def test_components_of_many_forms(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7), (1000, 1001), (900, 900)]
    edges += [(i, i + 1) for i in range(2000, 2200)] + [(4000 + i * 37 % 101, 4000 + (i + 1) * 37 % 101) for i in range(100)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        for x in todo:
            if x not in want:
                want[x] = start
                todo.extend(near[x])
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_a_loop_does_not_square_its_size(spark):
    """States are tables: what the planner thinks of their size doesn't grow with the rounds."""
    from geostrata.operators.state import settle

    df = settle(spark.range(100).select("id", F.col("id").alias("label")))
    for _ in range(12):
        df = settle(df.join(df.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", F.col("next").alias("label")), df)
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20
    assert df.count() == 100


def test_crossings_do_not_depend_on_the_cell(spark):
    rng = random.Random(8)
    seg = lambda far: (x := rng.randint(-60, 60), y := rng.randint(-60, 60), x + rng.randint(-far, far), y + rng.randint(-far, far))
    left = [(i, *seg(30)) for i in range(150)] + [(150, 0, 0, 0, 0), (151, -10, 0, 10, 0), (152, 0, -64, 0, 64)]
    right = [(i, *seg(90)) for i in range(40)] + [(40, 0, -10, 0, 10), (41, -10, 0, 10, 0)]
    want = set()
    for a, x, y, x2, y2 in left:
        for b, sx, sy, sx2, sy2 in right:
            d = (x2 - x) * (sy2 - sy) - (y2 - y) * (sx2 - sx)
            if d:
                t, s = ((sx - x) * (sy2 - sy) - (sy - y) * (sx2 - sx)) / d, ((sx - x) * (y2 - y) - (sy - y) * (x2 - x)) / d
                if 0 <= t <= 1 and 0 <= s <= 1:
                    want.add((a, b, t, s))
    a = spark.createDataFrame(left, "a int, x int, y int, x2 int, y2 int")
    b = spark.createDataFrame(right, "b int, sx int, sy int, sx2 int, sy2 int")
    for cell in (4.0, 16.0, 500.0):
        got = [(r.a, r.b, r.t, r.s) for r in spatial.crossing_pairs(a, b, cell).select("a", "b", "t", "s").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 200


@pytest.mark.parametrize("band", [1.0, 10.0, 1e6])
def test_overlaps_do_not_depend_on_the_band(spark, band):
    rng = random.Random(2)
    layers = lambda n: [(rng.randint(0, 2), f"{rng.choice('ABC')}{i}", t := rng.randint(-30, 60), t + rng.randint(0, 25)) for i in range(n)]
    a, b = layers(60), layers(60)
    want = {}
    for p, name, top, bottom in a:
        met = [(m[0] == name[0], min(bottom, y) - max(top, x), -x, m) for k, m, x, y in b if k == p and min(bottom, y) > max(top, x)]
        if met:
            want.setdefault((p, top, bottom), []).append(max(met)[:3])
    f = lambda rows: spark.createDataFrame(rows, "p int, name string, top int, bottom int")
    got = best_overlap(f(a).dropDuplicates(["p", "top", "bottom"]), f(b), "p", F.substring("name", 1, 1) == F.substring("r_name", 1, 1), [F.col("r_top")], band).collect()
    assert {(r.p, r.top, r.bottom) for r in got} == set(want)
    assert all((bool(r.same_class), r.overlap, -r.r_top) in want[r.p, r.top, r.bottom] for r in got)


def test_a_profile_of_very_many_layers_is_not_paired_with_itself(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("p"), F.lit("A").alias("name"), F.col("id").alias("top"), (F.col("id") + 1).alias("bottom"))
    out = best_overlap(rows, rows, "p", F.lit(True), [F.col("r_top")], band=8)
    assert out.agg(F.count("*"), F.count_if(F.col("top") == F.col("r_top")), F.sum("overlap")).first() == (n, n, n)


def test_segments_are_shuffled_about_once_and_never_broadcast(spark, sf):
    i, p = F.col("l_orderkey"), F.col("l_partkey")
    s = spark.read.parquet(f"{sf}/lineitem.parquet").select(i.alias("x"), (p % 97).alias("y"), (i + p * 7 % 41 - 20).alias("x2"), (F.col("l_suppkey") * 11 % 97).alias("y2"))
    assert spatial._pieces(s, ("x", "y", "x2", "y2"), 48.0 * spatial.SPREAD, "l").count() < 1.2 * s.count()
    plan = spatial.crossing_pairs(s, s.toDF("sx", "sy", "sx2", "sy2"), 48.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
