"""Every query against DuckDB on the smallest tables."""

import duckdb
import pytest

from geostrata.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


#: Queries that find nothing in the smallest tables.
SPARSE = ("all_squares_scene", "inside_runs", "section_crossings")


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def ducks(sf):
    return {d: connect(d) for d in (sf, "/root/testdata/sf0.01")}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(name, spark, ducks, sf):
    sf = "/root/testdata/sf0.01" if name in SPARSE else sf
    duck = ducks[sf]
    df = catalogue.QUERIES[name](spark, sf)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: NAMES[t] for c, t in df.dtypes} == kinds
    own = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    theirs = sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in sorted(rel.columns)) for r in rel.fetchall()), key=str)
    assert own == theirs
    assert own


def test_flagship(spark, sf):
    assert catalogue.QUERIES[catalogue.FLAGSHIP](spark, sf).count() > 0


def test_greedy_sequence_visits_all_once(spark, sf):
    rows = catalogue.QUERIES["greedy_sequence"](spark, sf).collect()
    assert sorted(r.poly for r in rows) == list(range(25)) and [r.step for r in rows] == list(range(25))


def test_no_python_in_plans(spark, sf):
    """Only what needs state along a line runs in Python."""
    for name, f in catalogue.QUERIES.items():
        if name in ("simplify_lines", "greedy_sequence", "visit_orders", "arbolate", "containment_closure", "components", "rotation_chain"):
            continue
        plan = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
        assert "CartesianProduct" not in plan, name
