"""A hundred thousand equal rows: no operator gathers them in one task."""

import pytest
from pyspark.sql import functions as F

from geostrata.llm import jaccard_join as J
from geostrata.llm import mixing as M
from geostrata.llm import quality as Q
from geostrata.llm import sharding as S

COPIES = 100_000


@pytest.fixture(scope="module")
def hot(spark):
    words = "one passage of words that stands in every copy of this row".split()
    copies = spark.range(COPIES).select(F.lit(None).cast("long").alias("doc_id"), F.lit(" ".join(words)).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    others = spark.range(300).select("id", F.concat_ws(" ", F.lit("row"), "id", F.col("id") * 7, F.lit("has its own words")).alias("text"), F.lit("t"), F.lit("en"))
    return copies.unionByName(others.toDF(*copies.columns)).repartition(8)


def test_shards_part_equal_rows(hot):
    got = S.assign_shards(hot, shards=8).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert len(got) == 8 and sum(r.n for r in got) == COPIES + 300 and all(r.last == r.n - 1 for r in got)
    assert max(r.bytes for r in got) < 1.02 * min(r.bytes for r in got)


def test_one_text_an_id_is_trained_on(spark, hot):
    docs = hot.select(F.coalesce("doc_id", F.lit(1000)).alias("doc_id"), "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1000, 1)], "doc_id long, quality int")
    once = docs.dropDuplicates(["doc_id"])
    (w, b), (v, c) = Q.train(docs, labels), Q.train(once, labels)
    assert b == c and (w == v).all()


def test_a_mix_takes_equal_rows_by_number(hot):
    taken = M.take(hot).groupBy("source").agg(F.count("*").alias("n")).collect()
    mixed = M.mix_sources(hot).groupBy("source").agg(F.sum("times").alias("n")).collect()
    assert {r.source: r.n for r in taken} == {r.source: r.n for r in mixed} and all(r.n for r in taken)


def test_one_of_equal_rows_stays(hot):
    kept = J.first_of_each(hot)
    assert kept.count() == 301 and kept.where("source = 's'").count() == 1


@pytest.mark.parametrize("f", [J.link_components, J.first_of_each])
def test_no_table_of_the_join_is_broadcast(spark, monkeypatch, f):
    """The driver holds nothing that grows with the documents: only keys of several blocks, a row for each 256 KB of shingles at most."""
    plans, put = [], J.put_table

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, *args)

    monkeypatch.setattr(J, "put_table", seen)
    monkeypatch.setattr(J, "BLOCK_BYTES", 500)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(39)] + ["a b c d e f g", "a b c d e f g"]
    seen(f(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")), "join-last")
    joins = [line for p in plans for line in p.split("\n") if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert len(plans) > 15 and len(joins) >= 3 and all("LeftOuter" in line and "cluster" in line for line in joins)
