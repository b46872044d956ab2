"""The streams end where their batch forms do."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from geostrata.streaming import jobs


@pytest.fixture
def feed(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    return jobs.event_stream(spark, str(tmp_path / "in"))


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_daily_counts(spark, sf, feed, tmp_path):
    got = {(r.day, r.event_type): r.n for r in drain(jobs.daily(feed, "60 days"), "daily", "update", tmp_path).groupBy("day", "event_type").agg(F.max("n").alias("n")).collect()}
    assert got == {(r.day, r.event_type): r.n for r in jobs.daily(jobs.events(spark, sf)).collect()}


def test_retries_block_for_good(spark, sf, feed, tmp_path):
    got = drain(jobs.retries(feed), "retries", "update", tmp_path).groupBy("user_id").agg(F.max("failures").alias("n"), F.max_by("state", "failures").alias("s")).collect()
    want = {r.user_id: r.n for r in jobs.events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n")).collect()}
    assert {r.user_id: r.n for r in got} == want and all(r.s == ("blocked" if r.n >= 3 else "ready") for r in got)


def test_ingest_keeps_the_latest_revision(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    rows = lambda ids, v: [(i, dt.datetime(2024, 1, 1 + i % 3), 5, "view", v, "{}") for i in ids]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for batch, v in (((1, 2), 1.0), ((4, 3), 2.0)):
        spark.createDataFrame(rows(batch, v), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.ingest(jobs.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = sorted((r.event_id, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(2, 1.0), (3, 2.0), (4, 2.0)]


@pytest.mark.parametrize("newest_first", [False, True])
def test_units_are_taken_once_however_late(spark, sf, tmp_path, newest_first):
    """Files come one by one, a whole time range each; an older file after a newer one is late, and still taken."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    days = [r.d for r in e.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    cuts = [days[0], days[len(days) // 3], days[2 * len(days) // 3]]
    parts = [e.where((F.to_date("ts") >= a) & ((F.to_date("ts") < b) if b else F.lit(True))) for a, b in zip(cuts, [*cuts[1:], None])]
    order = list(reversed(parts)) if newest_first else parts
    for part in [*order, parts[0]]:  # the first range comes twice
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = jobs.fresh(jobs.event_stream(spark, str(tmp_path / "in"))).select("event_id")
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.distinct().count() == e.count()


def test_sessions_split_at_the_gap(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, m)) for m in (0, 10, 50)], "user_id long, ts timestamp")
    assert sorted(r.n for r in jobs.sessions(df).collect()) == [1, 2]
