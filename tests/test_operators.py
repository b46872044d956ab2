"""Operators on literals with hand-made answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.functions import expressions as E
from geostrata.functions.simplify import kept
from geostrata.operators import graph, raster
from geostrata.operators import relational as R


def ring(points):
    return list(zip(points, points[1:] + points[:1], strict=True))


def test_fill_leaves_a_hole_open(spark):
    rows = [(1, *map(float, (*a, *b))) for a, b in ring([(0, 0), (10, 0), (10, 10), (0, 10)]) + ring([(4, 4), (6, 4), (6, 6), (4, 6)])]
    cells = raster.fill_even_odd(spark.createDataFrame(rows, "poly int, x double, y double, x2 double, y2 double"), ["poly"]).collect()
    assert len(cells) == 96
    assert not {(4, 4), (5, 5)} & {(r.row, r.col) for r in cells}


def test_fill_of_nothing(spark):
    assert raster.fill_even_odd(spark.createDataFrame([], "poly int, x double, y double, x2 double, y2 double"), ["poly"]).count() == 0


def test_labels_take_the_arc_to_the_west(spark):
    arcs = spark.createDataFrame([(2.0, 0.0, 2.0, 1.0, 2), (6.5, 0.0, 6.5, 1.0, 3), (12.5, 0.0, 12.5, 1.0, 1)], "x double, y double, x2 double, y2 double, label int")
    grid = spark.createDataFrame([(0, c) for c in (1, 3, 6, 7, 11, 13)], "row long, col long")
    got = {r.col: r.label for r in raster.label_scanlines(grid, arcs, "label").collect()}
    assert [got[c] for c in (1, 3, 6, 7, 11, 13)] == [0, 2, 3, 3, 3, 1]


def test_asof_takes_equal_and_last_tie(spark):
    left = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("b", 9.0)], "k string, t double")
    right = spark.createDataFrame([("a", 5.0, 7, 1), ("a", 5.0, 8, 2), ("a", 3.0, 6, 1)], "k string, t double, v int, tie int")
    got = {(r.k, r.t): r.v for r in R.asof_backward(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 5.0): 8, ("a", 1.0): None, ("b", 9.0): None}


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(4)] + [(2, 5.0), (2, None)], "k int, v double")
    got = {r.k: (r.lo, r.mid) for r in R.nearest_rank(df, ["k"], "v", {"lo": 0.0, "mid": 0.5}).collect()}
    assert got == {1: (0.0, 2.0), 2: (5.0, 5.0)}  # round(1.5) = 2


def test_division_needs_every_member(spark):
    df = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "a"), ("d2", "a")], "d string, m string")
    assert [r.d for r in R.divide(df, "d", "m", 2).collect()] == ["d1"]


def test_overlap_prefers_the_same_class(spark):
    left = spark.createDataFrame([(1, "Bt1", 45, 58)], "p int, name string, top int, bottom int")
    right = spark.createDataFrame([(1, "A2", 40, 55), (1, "B2", 55, 60), (2, "B9", 45, 58)], "p int, name string, top int, bottom int")
    got = R.best_overlap(left, right, "p", F.substring("name", 1, 1) == F.substring("r_name", 1, 1), [F.col("r_top")], 10.0).collect()
    assert [(r.r_name, r.overlap) for r in got] == [("B2", 3)]


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted((r.id, r.v) for r in R.upsert(old, new, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_share_of_nothing_is_nothing(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 3)], "k string, v int")
    assert sorted(r.s for r in df.select(R.share(F.col("v"), ["k"]).alias("s")).collect()) == [0.0, 0.0, 25.0, 75.0]


def test_braided_network(spark):
    nodes = spark.createDataFrame([(i, 1.0) for i in range(1, 8)], "node long, length double")
    # 1 and 2 join into 3, which splits into 4 and 5; both join again into 6; 7 feeds 4
    edges = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (3, 5), (7, 4), (4, 6), (5, 6)], "up long, down long")
    got = {r.node: r.total for r in graph.upstream_totals(nodes, edges).collect()}
    assert got == {1: 1.0, 2: 1.0, 7: 1.0, 3: 3.0, 4: 3.5, 5: 2.5, 6: 7.0}


def test_cycles_stay_null(spark):
    nodes = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "node long, length double")
    got = {r.node: r.total for r in graph.upstream_totals(nodes, spark.createDataFrame([(1, 2), (2, 1)], "up long, down long")).collect()}
    assert got == {1: None, 2: None, 3: 1.0}


def test_closure_ends_on_cycles(spark):
    got = sorted((r.a, r.b, r.depth) for r in graph.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")).collect())
    assert len(got) == 9 and (1, 3, 2) in got and (1, 1, 3) in got


def test_components_of_a_long_path(spark):
    got = graph.components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")).collect()
    assert {r.label for r in got if r.node <= 40} == {0} and {r.label for r in got if r.node >= 100} == {100}


def test_blur_keeps_a_constant(spark):
    grid = raster.cells(spark, 6, 5).withColumn("value", F.lit(3.5))
    assert {round(r.value, 9) for r in raster.box_blur(grid, 6, 5, 2).collect()} == {3.5}


def test_bilinear_on_a_plane(spark):
    grid = raster.cells(spark, 5, 5).withColumn("value", F.col("row") * 10.0 + F.col("col"))
    p = spark.createDataFrame([(1, 1.5, 2.25), (2, 4.0, 4.0), (3, 4.5, 0.0)], "id int, x double, y double")
    assert {r.id: r.value for r in raster.bilinear(p, grid, 5, 5).collect()} == {1: 24.0, 2: 44.0, 3: None}


def test_block_mean_of_a_plane(spark):
    grid = raster.cells(spark, 50, 100).withColumn("value", F.col("col") * 1.0)
    got = {(r["by"], r.bx): r["mean"] for r in raster.block_mean(grid, 50, 100, 10, 20).collect()}
    assert len(got) == 200 and got[0, 0] == 2.0 and got[9, 19] == 97.0


def test_simplify_drops_what_lies_near_the_chord():
    x, y = np.array([0.0, 5, 10, 10]), np.array([0.0, 0.5, 0, 10])
    assert kept(x, y, 1.0) == [0, 2, 3]
    assert kept(x[:1], y[:1], 1.0) == [0] and kept(np.zeros(3), np.zeros(3), 1.0) == [0, 2]


def test_projection_of_the_central_meridian(spark):
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(E.utm(F.lit(0.0), F.lit(-123.0), 10), ("e", "n"), strict=True)]).first()
    assert (round(row.e, 6), round(row.n, 6)) == (500000.0, 0.0)
    far = spark.range(1).select(*[c.alias(n) for c, n in zip(E.utm(F.lit(38.3), F.lit(-122.3), 10), ("e", "n"), strict=True)]).first()
    assert 561000 < far.e < 561400 and 4239000 < far.n < 4239700


def test_quarter_turn_about_the_pole(spark):
    q = E.quaternion_of_pole(F.lit(90.0), F.lit(0.0), F.lit(90.0))
    two = E.quaternion_product(q, q)
    half = E.slerp(E.quaternion_of_pole(F.lit(90.0), F.lit(0.0), F.lit(0.0)), two, F.lit(0.5))
    row = spark.range(1).select(two.alias("two"), half.alias("half")).first()
    assert abs(row.two.z - 1) < 1e-12 and abs(row.half.w - math.cos(math.pi / 4)) < 1e-12


@pytest.mark.parametrize(("sand", "silt", "clay", "name"), [(92, 5, 3, "sand"), (40, 40, 20, "loam"), (30, 35, 35, "clay loam"), (20, 20, 60, "clay"), (10, 85, 5, "silt"), (None, 1, 1, None)])
def test_texture_triangle(spark, sand, silt, clay, name):
    df = spark.createDataFrame([(sand, silt, clay)], "sand int, silt int, clay int")
    assert df.selectExpr(E.texture_class() + " as t").first().t == name


def test_classes_by_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (3, 10, 39, 40, 999, 1000)], "km int")
    assert [r.c for r in df.selectExpr(E.stream_class("km") + " as c").collect()] == [1, 2, 2, 3, 5, 6]
    heat = spark.createDataFrame([(2400,), (3318,), (4500,), (None,)], "h int").selectExpr(E.heat_region("h") + " as r").collect()
    assert [r.r for r in heat] == ["I", "III", "V", None]


def test_soil_colours(spark):
    df = spark.createDataFrame([("10YR", 4.0, 3.0), ("5R", 10.0, 0.0), ("odd", 4.0, 3.0), ("10YR", None, 3.0)], "h string, v double, c double")
    got = [r.x for r in df.select(E.soil_colour(F.col("h"), F.col("v"), F.col("c")).alias("x")).collect()]
    assert got[1] == "#ffffff" and got[0] == got[2] and got[3] is None
    r, g, b = (int(got[0][i : i + 2], 16) for i in (1, 3, 5))
    assert r > g > b and 90 < r < 130  # a dark brown


def test_datum_shift_is_about_a_hundred_metres(spark):
    lat, lon = E.nad27(F.lit(38.3), F.lit(-122.3))
    row = spark.range(1).select(((lat - 38.3) * 111000).alias("n"), ((lon + 122.3) * 87000).alias("e")).first()
    assert -40 < row.n < 40 and 60 < row.e < 130
    x, y, z = E.geocentric(F.lit(38.3), F.lit(-122.3), E.GRS80)
    back = spark.range(1).select(*[c.alias(n) for c, n in zip(E.geodetic(x, y, z, E.GRS80), "ab", strict=True)]).first()
    assert abs(back.a - 38.3) < 1e-9 and abs(back.b + 122.3) < 1e-9


def test_minimal_standard_generator(spark):
    # its published check: from seed 1 the ten thousandth number is 1043618065
    assert spark.range(1).select((E.uniform(F.lit(1), F.lit(10000)) * 2147483647).cast("long").alias("x")).first().x == 1043618065


def test_equal_area_origin(spark):
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(E.albers(F.lit(23.0), F.lit(-96.0)), "xy", strict=True)]).first()
    assert abs(row.x) < 1e-6 and abs(row.y) < 1e-6


def test_chains_compose_to_their_root(spark):
    links = spark.createDataFrame([(0, None, 1.0), (1, 0, 2.0), (2, 1, 3.0), (3, 2, 5.0), (9, 8, 7.0)], "node int, parent int, value double")
    got = {r.node: r.value for r in graph.compose_chains(links, lambda a, b: a * b).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 6.0, 3: 30.0, 9: None}


def test_planes_and_crossings(spark):
    df = spark.createDataFrame([([5, 3, 30000, -7, -30000],), ([1],)], "v array<int>")
    packed = df.select("v", E.to_planes("v").alias("p"))
    assert [bytes(r.p) for r in packed.collect()][1] == b"\x01\x00"
    assert all(r.v == r.back for r in packed.select("v", E.from_planes("p").alias("back")).collect())
    t, s = E.crossing(*(F.lit(x) for x in (0, 0, 10, 10, 0, 10, 10, 0)))
    assert tuple(spark.range(1).select(t, s).first()) == (0.5, 0.5)


def test_page_rules_by_literals(spark):
    from geostrata.plans.checks import page_rule_counts

    html = '<script src="//bad.example/x.js"></script><SCRIPT src=https://unpkg.com/y.js integrity="sha384-a"></script><a target=_blank rel="noopener" href=x>a</a><a href=y target="_blank">b</a><script>new Function("x")</script>'
    got = page_rule_counts(spark.createDataFrame([(1, html), (2, "")], "page_id long, html string")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 1, 1), (2, 0, 0, 0, 0)]


def test_a_grid_that_breaks_its_metadata_is_an_error(spark):
    from geostrata.plans.checks import checked_grid

    fine = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "row long, col long, value double")
    assert checked_grid(fine, 1, 2).count() == 2
    for bad in (fine.unionByName(fine), fine.withColumn("row", F.col("row") + 1)):
        with pytest.raises(Exception, match="out of grid"):
            checked_grid(bad, 1, 2).collect()


def test_samples_of_repeated_points_and_missing_cells(spark):
    from geostrata.operators import raster

    g = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(4) if (r, c) != (2, 3)], "row long, col long, value double")
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5), (2, 0.5, 0.5), (3, 3.5, 0.0), (4, 2.5, 1.5), (5, None, 1.0), (6, 9.0, 0.0)], "id int, x double, y double")
    flat = sorted((r.id, r.value) for r in raster.bilinear(p, g, 3, 4).collect())
    assert flat == [(1, 5.5), (2, 5.5), (2, 5.5), (3, None), (4, None), (5, None), (6, None)]
    around = {r.id: r.value for r in raster.bilinear_round(p, g, 3, 4).collect()}
    assert around == {1: 5.5, 2: 5.5, 3: 1.5, 4: None, 5: None, 6: 1.0}
    near = {r.id: r.value for r in raster.nearest(p, g).collect()}
    assert near == {1: 11.0, 2: 11.0, 3: None, 4: None, 5: None, 6: None}
    assert raster.bilinear(p.limit(0), g, 3, 4).count() == 0 == raster.nearest(p.limit(0), g).count()


def _visited(items, touch):
    """Order of one group, from all gaps anew at each step."""
    place = {i: (x, y, r) for i, _, x, y, r in items}
    up = {i: p for i, p, *_ in items if p in place and p != i}
    far = lambda a, b: math.sqrt((place[a][0] - place[b][0]) ** 2 + (place[a][1] - place[b][1]) ** 2)

    def inside(i, seen):
        above, walked = up.get(i), set()
        while above is not None and above not in walked:
            if above in seen:
                return True
            walked.add(above)
            above = up.get(above)
        return False

    seen = [min(place)]
    out = [(0, seen[0], "start", False, 0.0)]
    while left := [i for i in place if i not in seen and not inside(i, seen)]:
        gap = {i: min(max(0.0, far(i, s) - place[i][2] - place[s][2]) for s in seen) for i in left}
        close = [i for i in left if gap[i] <= touch]
        g, i = min((far(i, seen[-1]), i) for i in close) if close else min((gap[i], i) for i in left)
        seen.append(up.get(i, i))
        out.append((len(out), seen[-1], "touches" if close else "closest", i in up, round(g, 6)))
    return out


def test_visit_orders_against_all_gaps(spark):
    draw = random.Random(5)
    groups = {}
    for g in (None, 0, 1, 2, 1 << 60):
        ids = [(1 << 60) + k for k in draw.sample(range(100), 30)]
        # places on a coarse lattice make ties; parents may be missing, themselves or in circles
        groups[g] = [(i, draw.choice([None, None, i, *ids, 7]), draw.randrange(12) * 5.0, draw.randrange(12) * 5.0, float(draw.randrange(3))) for i in ids]
    rows = [(g, *it) for g, items in groups.items() for it in items] + [(0, None, None, 1.0, 1.0, 1.0), (0, 3, None, None, 1.0, 1.0)]
    schema = "grp long, item long, parent long, x double, y double, r double"
    found = graph.visit_orders(spark.createDataFrame(rows, schema).repartition(5), 4.0).collect()
    for g, items in groups.items():
        got = sorted((r.step, r.item, r.why, r.promoted, round(r.gap, 6)) for r in found if r.grp == g)
        assert got == _visited(items, 4.0), g
    assert {r.why for r in found} == {"start", "touches", "closest"} and any(r.promoted for r in found)
    assert graph.visit_orders(spark.createDataFrame([], schema), 4.0).count() == 0


def test_visit_orders_of_a_group_past_its_bound(spark):
    rows = spark.range(12).selectExpr("0 as grp", "id as item", "cast(null as long) as parent", "id as x", "0 as y", "null as r")
    assert [r.item for r in graph.visit_orders(rows, 1.0, most=12).orderBy("step").collect()] == list(range(12))
    with pytest.raises(Exception, match="more than 11 items"):
        graph.visit_orders(rows, 1.0, most=11).collect()
