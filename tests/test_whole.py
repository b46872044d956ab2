"""Queries over whole tables: what a filter by id would drop is there."""

import json
import math

import duckdb
import numpy as np
import pytest

from geostrata.functions import simplify
from geostrata.operators import graph
from geostrata.plans import catalogue, rules


def by_sql(name, *tables):
    """Rows of a query's SQL, columns by name."""
    c = duckdb.connect()
    for t, path in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    rel = c.sql(catalogue.ORACLES[name])
    places = [rel.columns.index(x) for x in sorted(rel.columns)]
    return sorted((tuple(r[i] for i in places) for r in rel.fetchall()), key=str)


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_nest_hierarchy_has_lines_of_high_keys(spark, tmp_path):
    spark.createDataFrame([(1, 7, 5.0), (250_000, 8, 6.0), (300_000, 9, 7.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 11, 2.0), (250_000, 2, 12, 3.0), (250_000, 1, 13, 4.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.component: (r.unit, r.depth, r.first_part, r.layers) for r in catalogue.QUERIES["nest_hierarchy"](spark, str(tmp_path)).collect()}
    assert got == {1: (7, 2.0, 11, "2"), 250_000: (8, 7.0, 13, "4/3"), 300_000: (9, None, -1, None)}


def test_line_brush_draws_every_line(spark, sf):
    got = rows(catalogue.QUERIES["line_brush"](spark, sf))
    assert got == by_sql("line_brush", ("lineitem", sf))


def test_pattern_key_join_has_every_order(spark, sf):
    got = rows(catalogue.QUERIES["pattern_key_join"](spark, sf))
    assert got == by_sql("pattern_key_join", ("orders", sf))


def test_hold_last_has_every_cell(spark, sf):
    got = rows(catalogue.QUERIES["hold_last"](spark, sf))
    assert got == by_sql("hold_last", ("events", sf))


def parts(spark, folder, n=700):
    size = {k: k * 37 % 50 + 1 for k in range(n)}
    spark.createDataFrame(list(size.items()), "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    return size


def test_arbolate_has_every_part(spark, tmp_path):
    size = parts(spark, tmp_path)
    total = {k: float(s) for k, s in size.items()}
    for k in sorted(size, reverse=True):  # all that flows into a part has a greater key
        down = [k // 2, k // 3] if k % 10 == 0 else [k // 2]
        for d in down if k else ():
            total[d] += total[k] / len(down)
    got = {r.node: r.total for r in catalogue.QUERIES["arbolate"](spark, str(tmp_path)).collect()}
    assert got.keys() == total.keys() and all(abs(got[k] - total[k]) < 1e-5 for k in total)


def test_rotation_chain_has_every_part(spark, tmp_path):
    size = parts(spark, tmp_path)
    angle = {}
    for k in sorted(size):
        angle[k] = math.radians(size[k] * 3.0) + (angle[k // 3] if k else 0.0)
    got = {r.node: (r.root, r.w, r.z) for r in catalogue.QUERIES["rotation_chain"](spark, str(tmp_path)).collect()}
    assert got.keys() == angle.keys()
    assert all(r == 0 and abs(w - math.cos(angle[k] / 2)) < 1e-8 and abs(z - math.sin(angle[k] / 2)) < 1e-8 for k, (r, w, z) in got.items())


def test_components_has_every_cell(spark, tmp_path):
    cells = {(r, c) for r in range(64) for c in range(64) if (r * 7 + c * 11) % 5 < 3 and (r + c) % 9}
    lines = [(r, c, 100.0 if (r, c) in cells else 400.0) for r in range(64) for c in range(64)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    label, left = {}, set(cells)
    for start in sorted(cells):
        pool = [start] if start in left else []
        left.discard(start)
        for r, c in pool:
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.discard(n)
                    pool.append(n)
        if pool:
            label[start[0] * 64 + start[1]] = len(pool)
    got = {r.label: r.cells for r in catalogue.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert got == label


def test_upstream_totals_cuts_cycles_where_they_close(spark):
    nodes = spark.createDataFrame([(i, 10.0**i) for i in range(1, 7)], "node long, length double")
    # 5 flows into the cycle 1 > 2 > 3 > 1, which leaves by 3 > 4; 6 flows into itself alone
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 2), (6, 6)], "up long, down long")
    got = {r.node: r.total for r in graph.upstream_totals(nodes, edges, cut_cycles=True).collect()}
    two = 1e2 + 1e5  # the edge 1 > 2 is cut; half of 3 goes to 1, half to 4
    three = 1e3 + two
    assert got == {1: 1e1 + three / 2, 2: two, 3: three, 4: 1e4 + three / 2, 5: 1e5, 6: 1e6}


def test_a_limit_of_a_graph_loop_is_an_error_not_a_cut(spark):
    nodes = spark.createDataFrame([(i, 1.0) for i in range(4)], "node long, length double")
    chain = spark.createDataFrame([(i, i + 1) for i in range(3)], "a long, b long")
    with pytest.raises(ValueError):
        graph.upstream_totals(nodes, chain.toDF("up", "down"), most=2)
    with pytest.raises(ValueError):
        graph.closure(chain, most=2)
    assert graph.closure(chain, most=3).count() == 6


def test_each_secret_and_code_rule_by_a_literal(spark):
    secrets = ["AKIA" + "A1" * 8, "ghp_" + "a1" * 18, "github_pat_" + "a1_" * 20, "sk-ant-" + "a-1_" * 5, "sk-proj-" + "a1" * 16, "AIza" + "b" * 35, "xoxb-" + "1" * 10, "-----BEGIN RSA " + "PRIVATE KEY-----"]
    code = ["run(x, shell = True)", "y = eval(x)", "pickle.loads(x)", "yaml.load(x)", "get(u, verify=False)", "z.extractall(p)", "urlopen(u)"]
    fine = ["AKIA1", "sk-short", "model.eval()", "yaml.load(x, Loader=SafeLoader)", "a  # eval(x)"]
    docs = spark.createDataFrame([(1, "\n".join(secrets)), (2, "\n".join(code)), (3, "\n".join(fine)), (4, None)], "doc_id long, text string")
    for key, table, comment in ((1, rules.SECRETS, None), (2, rules.CODE, "#")):
        got = sorted(tuple(r) for r in rules.line_findings(docs, "doc_id", "text", table, comment).collect())
        assert got == [(key, i, n) for i, n in enumerate(table, 1)]


def test_simplification_by_line_and_great_circle():
    x, y = np.array([0.0, 15.0, 10.0]), np.array([0.0, 0.5, 0.0])
    assert simplify.kept(x, y, 1.0) == [0, 1, 2] and simplify.kept_by_line(x, y, 1.0) == [0, 2] and simplify.kept_by_line(x, y, 0.4) == [0, 1, 2]
    lon, lat = np.array([0.0, 45.0, 90.0]), np.array([60.0, 60.0, 60.0])  # the great circle rises to 67.8 degrees between
    assert simplify.kept_on_sphere(lon, lat, 8.0) == [0, 2] and simplify.kept_on_sphere(lon, lat, 7.0) == [0, 1, 2]


def test_chains_stop_at_the_stated_length(spark):
    """A node sixty links from its root has a value, one further has none."""
    links = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(64)], "node int, parent int, value int")
    got = {r.node: (r.root, r.value) for r in graph.compose_chains(links, lambda a, b: a + b).collect()}
    assert got == {i: (0, i + 1) if i <= 60 else (None, None) for i in range(64)}


def test_budgeted_concat_sums_whole_groups(spark, tmp_path):
    docs = [(k, "a", 900) for k in range(5000)] + [(k, "b", None if k < 3 or k % 7 == 0 else 11) for k in range(990, 1200)] + [(7, None, 59_999), (7, None, 1), (8, None, 1), (None, "b", 5), (3, "c", 60_001)]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars int").selectExpr("*", "'en' AS lang").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    files = duckdb.sql(f"SELECT source, doc_id, n_chars, lang FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    c = duckdb.connect()
    c.register("documents", files.arrow())
    got = {r.source: (r.fit, r.ids, r.total) for r in catalogue.QUERIES["budgeted_concat"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[1:] for r in c.sql(catalogue.ORACLES["budgeted_concat"]).fetchall()}
    assert got["a"] == (66, ",".join(map(str, range(66))), 4_500_000) and got[None] == (2, "7,7", 60_001) and got["c"] == (0, "", 60_001)


def test_document_sinks_holds_a_whole_group_in_a_document(spark, tmp_path):
    parts = [(k, "x", k % 50) for k in range(1500)] + [(2, "y", None), (600, "y", 4), (None, "y", 4), (1, "z", None)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").repartition(5).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_brand: r.doc for r in catalogue.QUERIES["document_sinks"](spark, str(tmp_path)).collect()}
    assert list(got) and got["y"] == '{"type":"FeatureCollection","features":[{"id":600,"size":4}]}' and got["z"] is None
    assert [(f["id"], f["size"]) for f in json.loads(got["x"])["features"]] == [(k, k % 50) for k in range(1500)]
