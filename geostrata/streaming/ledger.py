"""A ledger of units for resumable ingest: what was taken, what failed, what is given up.

A unit is taken once for each revision; repeats and older revisions are passed over. A
failed unit is recorded and due again after a wait, and after a number of failures it is
blocked for good. Entries that no row touches for a while leave the ledger, so that it
holds the units of that span and not those of all time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and time-to-live need; and no batches without data, which timers would ask for without end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
DAY_MS = 86_400_000
OUT = "unit string, revision long, status string, attempts int, value double, reason string"


class Ledger(StatefulProcessor):
    """Rows of (unit, revision, value): taken, failed and blocked as they come, due when a wait is over."""

    def __init__(self, most: int, wait_ms: int, keep_ms: int):
        self.most, self.wait, self.keep = most, wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "revision long", ttlDurationMs=self.keep)
        self.failures = handle.getValueState("failures", "n int, revision long, reason string", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (unit,) = key
        last = self.taken.get()[0] if self.taken.exists() else None
        failed = self.failures.get()[0] if self.failures.exists() else 0
        for row in sorted(rows, key=lambda r: r.revision):
            if last is not None and row.revision <= last:
                continue
            if failed >= self.most:  # blocked for good
                break
            bad = row.value is None or not math.isfinite(row.value)
            if not bad:
                last, failed = row.revision, 0
                self.taken.update((last,))
                self.failures.clear()
                yield Row(unit=unit, revision=last, status="taken", attempts=0, value=float(row.value), reason=None)
                continue
            failed += 1
            reason = "no value" if row.value is None else f"value {row.value}"
            self.failures.update((failed, row.revision, reason))
            blocked = failed >= self.most
            if not blocked:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
            yield Row(unit=unit, revision=row.revision, status="blocked" if blocked else "failed", attempts=failed, value=None, reason=reason)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.failures.exists():
            n, revision, reason = self.failures.get()
            if n < self.most:
                yield Row(unit=key[0], revision=revision, status="due", attempts=n, value=None, reason=reason)

    def close(self) -> None:
        pass


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with the settings that the ledger needs. Waits that are over are told with the next data."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def units(df: DataFrame, unit: Column, revision: Column, value: Column, most: int = 3, wait_ms: int = DAY_MS, keep_ms: int = 90 * DAY_MS) -> DataFrame:
    """unit, revision, status (taken, failed, blocked or due), attempts, value and reason, as the ledger of a stream gives them.

    A revision of a taken unit is taken again if its number is greater. A value that is null or not finite is a failure of
    its unit; after ``most`` without a good value between the unit is blocked. A unit that comes after its entry has gone
    (``keep_ms`` without any change) is taken as new: sinks must take a unit twice without harm.
    """
    plain = df.select(unit.alias("unit"), revision.cast("long").alias("revision"), value.cast("double").alias("value")).where("unit is not null and revision is not null")
    return plain.groupBy("unit").transformWithState(Ledger(most, wait_ms, keep_ms), OUT, "Update", "ProcessingTime")


def run(entries: DataFrame, taken, side: str, checkpoint: str):
    """A query that gives the taken units of each batch to ``taken(batch, batch_id)`` and writes all others to the table ``side``, a folder a batch."""

    def split(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            kept.where("status <> 'taken'").drop("value").write.mode("overwrite").parquet(f"{side.rstrip('/')}/batch={batch_id}")
            taken(kept.where("status = 'taken'").select("unit", "revision", "value"), batch_id)
        finally:
            kept.unpersist()

    return entries.writeStream.foreachBatch(split).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
