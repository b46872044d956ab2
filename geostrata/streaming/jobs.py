"""Structured Streaming jobs over the events table; each transformation also takes a batch DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geostrata.session import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with a zoned timestamp, as watermarks need it."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Parquet files of events as they come into a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def watermarked(df: DataFrame, delay: str = "2 days") -> DataFrame:
    return df.withWatermark("ts", delay) if df.isStreaming else df


def daily(df: DataFrame, delay: str = "2 days") -> DataFrame:
    """Counts and totals of each kind and day (tumbling)."""
    w = F.window("ts", "1 day")
    return watermarked(df, delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


def trailing(df: DataFrame) -> DataFrame:
    """Weeks that begin on each day (sliding)."""
    return watermarked(df).groupBy(F.window("ts", "7 days", "1 day")).agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("window.start").alias("start"), "n", "top")


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return watermarked(df).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def fresh(df: DataFrame, unit: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Each unit once, however late it first comes; repeats are dropped.

    The state store is the ledger of the units seen: one key a unit, kept for good, so that no watermark applies. With many
    units set RocksDB as the store, which keeps them on disk. ``ledger.units`` forgets after a span, and records failures.
    """
    return df.dropDuplicates(list(unit))


def ingest(df: DataFrame, path: str, checkpoint: str):
    """Keeps a table partitioned by month with the latest revision of each unit. A batch rewrites the months that it touches, and only those; a batch that is run again gives the same table.

    A driver that dies while a batch's months are swapped leaves them to the batch's next run; where readers must never see
    that, ``cubes.ingest_years`` puts an index in place last.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.select("event_id", "ts", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM").alias("month"))
        months = [r.month for r in new.select("month").distinct().collect()]  # months of one batch
        if not months:
            return
        rows = new
        store = spark._jvm.org.apache.hadoop.fs.Path(path)
        if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
            rows = spark.read.schema(new.schema).parquet(path).where(F.col("month").isin(months)).unionByName(new)
        best = rows.groupBy("event_type", F.to_date("ts").alias("day"), (F.col("user_id") % 24).alias("cell"), "month").agg(F.max(F.struct("event_id", "ts", "user_id", "value")).alias("r"))
        out = best.select("r.event_id", "r.ts", "r.user_id", "event_type", "r.value", "month").checkpoint()
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retries(df: DataFrame, most: int = 3) -> DataFrame:
    """user_id, failures, state after each batch: ready until the ``most``-th failure, then blocked for good."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        failures += sum(int((b["event_type"] == "click").sum()) for b in batches)
        state.update((failures,))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [failures], "state": ["blocked" if failures >= most else "ready"]})

    return df.groupBy("user_id").applyInPandasWithState(step, "user_id long, failures long, state string", "failures long", "update", GroupStateTimeout.NoTimeout)
