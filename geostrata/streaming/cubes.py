"""Packed years as a sink: a stream of daily values keeps one binary file a year, and an index of them.

A batch merges its units into those of the years that it touches, packs these years anew
and then puts a new index in place. Files carry the batch in their names and are read by
way of the index alone, so that a batch is there whole or not at all; one that is run
again writes the same bytes under the same names.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.sources.grids import put_file, store

#: Code of a value that is missing, and codes to a unit of the others.
NODATA, CODES = -32768, 10
#: Values that a writer holds at once.
AT_ONCE = 1 << 20


def days_of(year: int) -> int:
    return (dt.date(year + 1, 1, 1) - dt.date(year, 1, 1)).days


def index_of(root: str) -> dict:
    """The index of a cube; an empty one where nothing is packed yet."""
    system, place = store(f"{root.rstrip('/')}/index.json")
    if not system.get_file_info(place).is_file:
        return {"batch": -1, "years": {}}
    with system.open_input_file(place) as f:
        return json.loads(f.read())


class _Year:
    """Writes one year's codes in order, with a code for what is missing, beside its place and then into it."""

    def __init__(self, root: str, year: int, batch: int, planes: int, cells: int):
        self.name = f"daily/{year}-{batch}.bin"
        self.system, self.place = store(f"{root.rstrip('/')}/{self.name}")
        self.system.create_dir(self.place.rsplit("/", 1)[0], recursive=True)
        self.year, self.size, self.cells = year, planes * days_of(year) * cells, cells
        self.beside = f"{self.place}.{uuid.uuid4().hex}.part"
        self.out, self.at, self.sum, self.days = self.system.open_output_stream(self.beside), 0, hashlib.sha256(), set()

    def put(self, at: np.ndarray, codes: np.ndarray) -> None:
        """Codes at rising places, none before the last."""
        end = int(at[-1]) + 1
        for start in range(self.at, end, AT_ONCE):
            stop = min(end, start + AT_ONCE)
            buf = np.full(stop - start, NODATA, "<i2")
            a, b = np.searchsorted(at, (start, stop))
            buf[at[a:b] - start] = codes[a:b]
            self._write(buf)
        self.at = end
        self.days.update(np.unique(at[codes != NODATA] // self.cells % days_of(self.year)).tolist())

    def _write(self, buf: np.ndarray) -> None:
        self.out.write(buf.tobytes())
        self.sum.update(buf.tobytes())

    def close(self) -> dict:
        for start in range(self.at, self.size, AT_ONCE):
            self._write(np.full(min(self.size, start + AT_ONCE) - start, NODATA, "<i2"))
        self.out.close()
        self.system.move(self.beside, self.place)
        return {"year": self.year, "file": self.name, "sha256": self.sum.hexdigest(), "days_with_data": len(self.days), "last_day": (dt.date(self.year, 1, 1) + dt.timedelta(max(self.days, default=0))).isoformat()}


def pack_years(units: DataFrame, root: str, batch: int, variables: list[str], cells: int) -> DataFrame:
    """year, file, sha256, days_with_data and last_day of the packed years of ``units`` (variable, day, cell, value).

    A file holds 16-bit little-endian tenths by variable, day of the year and cell. Values beyond the range of a code stop
    at it. A year is written in order by one task, which holds a stretch of it.
    """
    number = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(variables) for x in (v, i)]), F.col("variable"))
    year = F.year("day")
    value = F.when(~F.isnan("value"), F.col("value"))
    code = F.when(value.isNotNull(), F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), F.bround(value * CODES)))).cast("int")
    length = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    at = (number * length + F.dayofyear("day") - 1).cast("long") * cells + F.col("cell")
    rows = units.select(year.alias("year"), at.alias("at"), code.alias("code")).where("at is not null")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Year | None = None
        done = []
        for b in batches:
            frame = b.to_pandas()
            for y, part in frame.groupby("year", sort=False):
                if open_ is None or open_.year != y:
                    if open_ is not None:
                        done.append(open_.close())
                    open_ = _Year(root, int(y), batch, len(variables), cells)
                open_.put(part["at"].to_numpy(), part["code"].fillna(NODATA).to_numpy().astype("<i2"))
        if open_ is not None:
            done.append(open_.close())
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done).astype({"year": "int32", "days_with_data": "int32"}), preserve_index=False)

    dealt = rows.repartition("year").sortWithinPartitions("year", "at")
    return dealt.mapInArrow(write, "year int, file string, sha256 string, days_with_data int, last_day string")


def prune(root: str, index: dict) -> None:
    """Delete what batches before the index's left and it doesn't name: years packed anew since, and files of tasks that failed."""
    named = {y[k] for y in index["years"].values() for k in ("file", "units")}
    for part in ("daily", "units"):
        system, place = store(f"{root.rstrip('/')}/{part}")
        for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            batch = re.search(r"-(\d+)\.bin|batch=(\d+)$", f.base_name)
            old = batch is not None and int(batch[1] or batch[2]) < index["batch"]
            if old and not any(n == f"{part}/{f.base_name}" or n.startswith(f"{part}/{f.base_name}/") for n in named):
                (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)


def merge(batch: DataFrame, batch_id: int, root: str, variables: list[str], cells: int) -> dict:
    """The index after a batch of units (variable, day, cell, revision, value): the latest revision of each unit counts.

    Only touched years are read and packed. A batch that the index already has changes nothing.
    """
    spark: SparkSession = batch.sparkSession
    index = index_of(root)
    if batch_id <= index["batch"]:
        return index
    prune(root, index)
    new = batch.select("variable", F.col("day").cast("date").alias("day"), F.col("cell").cast("int").alias("cell"), F.col("revision").cast("long").alias("revision"), F.col("value").cast("double").alias("value"))
    new = new.where(F.col("variable").isin(variables) & F.col("cell").between(0, cells - 1) & F.col("day").isNotNull())
    touched = [str(r.y) for r in new.select(F.year("day").alias("y")).distinct().collect()]  # years of one batch
    rows = new
    for y in touched:
        if y in index["years"]:
            rows = rows.unionByName(spark.read.schema(new.schema).parquet(f"{root.rstrip('/')}/{index['years'][y]['units']}"))
    best = rows.groupBy("variable", "day", "cell").agg(F.max(F.struct("revision", "value")).alias("r")).select("variable", "day", "cell", "r.revision", "r.value")
    folder = f"units/batch={batch_id}"
    best.withColumn("year", F.year("day")).write.mode("overwrite").partitionBy("year").parquet(f"{root.rstrip('/')}/{folder}")
    units = spark.read.schema(new.schema).parquet(f"{root.rstrip('/')}/{folder}")
    packed = pack_years(units, root, batch_id, variables, cells).collect()  # a row a year
    years = dict(index["years"]) | {str(r.year): {"file": r.file, "sha256": r.sha256, "days": days_of(r.year), "days_with_data": r.days_with_data, "last_day": r.last_day, "units": f"{folder}/year={r.year}"} for r in packed}
    out = {"batch": batch_id, "vars": variables, "cells": cells, "scale": 1 / CODES, "nodata": NODATA, "layout": "int16 LE [var][day of year][cell]", "years": dict(sorted(years.items())), "last_day": max((y["last_day"] for y in years.values()), default=None)}
    put_file(f"{root.rstrip('/')}/index.json", json.dumps(out, indent=1).encode())
    return out


def ingest_years(df: DataFrame, root: str, checkpoint: str, variables: list[str], cells: int):
    """The stream of units (variable, day, cell, revision, value) that keeps the cube below ``root``."""
    return df.writeStream.foreachBatch(lambda b, i: merge(b, i, root, variables, cells) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
