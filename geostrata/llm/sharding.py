"""Sharding by histogram sort.

Rows are ordered by (CRC of the text, id). Splitters for shards of near equal bytes are
found by probing: count exactly the bytes and rows below candidate keys across all
partitions, keep for each splitter the two probes around its target, and probe between
them anew. When few rows lie between, their keys are fetched and the splitter is exact.
Shards of many rows are cut into pieces by probes that need only come near their targets;
there are at most PIECES of them at any size. One exchange then brings each piece
together; a row's slot is the piece's first slot, known from the counts, plus its rank.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.llm.common import put_table, table

SHARDS = 40
#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: A splitter may be this share of a shard's bytes from its target.
TOLERANCE = 0.002
#: Candidate keys of a round, and most rows between two probes whose keys are fetched.
PROBES, FETCH = 4096, 512
#: A piece that one task sorts has about this many rows, or more where there would be more than PIECES pieces, and is within this share of its size from its target.
TASK_ROWS, PIECES, ROUGH = 100_000, 4096, 0.25


def _buckets(crc: np.ndarray, key: np.ndarray, probes: list[tuple[int, int]]) -> np.ndarray:
    """Number of probes at or below each (crc, key)."""
    high = np.array([p[0] for p in probes], np.int64)
    low = np.array([p[1] for p in probes], np.int64)
    first, last = np.searchsorted(high, crc, "left"), np.searchsorted(high, crc, "right")
    out = first.copy()
    tied = np.flatnonzero(first < last)
    for c in np.unique(crc[tied]):
        rows = tied[crc[tied] == c]
        a, b = np.searchsorted(high, c, "left"), np.searchsorted(high, c, "right")
        out[rows] = a + np.searchsorted(low[a:b], key[rows], "right")
    return out


def _histogram(keys: DataFrame, probes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe, then of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            crc, key, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            b = _buckets(crc, key, probes)
            rows += np.bincount(b, minlength=len(rows))
            np.add.at(size, b, n)
        at = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(size[at]), pa.array(rows[at])], names=["bucket", "bytes", "n"])

    parts = keys.select("crc", "key", "size").mapInArrow(run, "bucket int, bytes long, n long")
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect():  # a row for each bucket
        size[r.bucket], rows[r.bucket] = r.bytes, r.n
    return np.cumsum(size), np.cumsum(rows)


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, fine: int = 1) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(crc, key) lower bounds of pieces 1 .. shards * fine - 1, and rows below each: shards of near equal bytes, cut into ``fine`` pieces of about equal bytes."""
    total = keys.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).first()
    pieces = shards * fine
    if not total.n or pieces < 2:
        return [], np.empty(0, np.int64)
    width = total.high - total.low + 1  # keys as one number: crc * width + key - low

    def pair(x: int) -> tuple[int, int]:
        return x // width, x % width + total.low

    # of each splitter: target, how far from it will do, and whether it parts two shards
    goals = [(total.bytes * (i + 1) / pieces, (tolerance * fine if (i + 1) % fine == 0 else ROUGH) * total.bytes / pieces, (i + 1) % fine == 0) for i in range(pieces - 1)]
    # for each goal: highest number known to be below, lowest known to be above, with bytes and rows below them
    span = [[(0, 0, 0), ((1 << 32) * width, total.bytes, total.n)] for _ in goals]

    def far(g: tuple[float, float, bool], s: list[tuple[int, int, int]]) -> bool:
        return s[1][0] - s[0][0] > 1 and min(abs(s[0][1] - g[0]), abs(s[1][1] - g[0])) > g[1]

    while True:
        open_ = [s for g, s in zip(goals, span, strict=True) if far(g, s) and s[1][2] - s[0][2] > FETCH]
        if not open_:
            break
        ranges = sorted({(s[0][0], s[1][0]) for s in open_})
        each = max(2, PROBES // len(ranges))
        numbers = sorted({a + (b - a) * (i + 1) // (each + 1) for a, b in ranges for i in range(each)} - {a for a, _ in ranges})
        below, rows = _histogram(keys, [pair(x) for x in numbers])
        known = [(x, int(below[i]), int(rows[i])) for i, x in enumerate(numbers)]
        at = [b for _, b, _ in known]
        for g, s in zip(goals, span, strict=True):
            i = bisect.bisect_right(at, g[0])
            if i and known[i - 1][0] > s[0][0]:
                s[0] = known[i - 1]
            if i < len(known) and known[i][0] < s[1][0]:
                s[1] = known[i]
    # at most FETCH rows lie in each range that is still open; those of shards are fetched, FETCH for each at most
    close = sorted({(s[0][0], s[1][0]) for g, s in zip(goals, span, strict=True) if g[2] and far(g, s)})
    rows: list[tuple[int, int]] = []
    if close:
        edges = sorted({x for r in close for x in r})
        wanted = {edges.index(a) + 1 + i for a, b in close for i in range(edges.index(b) - edges.index(a))}
        bounds = [pair(x) for x in edges]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pick = np.array(sorted(wanted))
            for batch in batches:
                crc, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                yield batch.filter(pa.array(np.isin(_buckets(crc, key, bounds), pick)))

        got = keys.select("crc", "key", "size").mapInArrow(run, "crc long, key long, size long").collect()
        rows = sorted(((r.crc * width + r.key - total.low), r.size) for r in got)
    numbers_of = [x for x, _ in rows]
    found: list[tuple[int, int]] = []
    for g, s in zip(goals, span, strict=True):
        best = min(s, key=lambda x: abs(x[1] - g[0]))
        if g[2] and far(g, s):
            x, b, n = s[0]
            i = bisect.bisect_left(numbers_of, x)
            while i < len(rows) and rows[i][0] < s[1][0]:
                j = i
                while j < len(rows) and rows[j][0] == rows[i][0]:  # rows of one key stay together
                    b, n, j = b + rows[j][1], n + 1, j + 1
                x, i = rows[i][0] + 1, j
                if abs(b - g[0]) < abs(best[1] - g[0]):
                    best = (x, b, n)
                if b > g[0]:
                    break
        found.append((best[0], best[2]))
    # splitters rise: a rough one must not pass that of the next shard, nor fall behind the last one
    low, high = (0, 0), ((1 << 32) * width, int(total.n))
    for i, g in enumerate(goals):
        end = next((found[j] for j in range(i, len(goals)) if goals[j][2]), high) if not g[2] else found[i]
        found[i] = low = min(max(found[i], low), end) if not g[2] else max(found[i], low)
    return [pair(x) for x, _ in found], np.array([n for _, n in found], np.int64)


def _numbered(base: DataFrame) -> DataFrame:
    """The rows of doc_id, size, crc and key, with keys that number equal rows from 0: key * most copies + number, ids counted from the smallest."""
    same = put_table(base.groupBy("doc_id", "size", "crc", "key").agg(F.count("*").alias("rows")), "shard-same")
    known = same.agg(F.max("rows").alias("most"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    step = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / 1024)))
    rows = same.withColumn("step", step).withColumn("number", F.explode(F.sequence(F.col("step") * 1024, F.least(F.col("rows"), F.col("step") * 1024 + 1024) - 1)))
    key = F.col("key")
    if known.most and known.most > 1:
        low, high = known.low or 0, known.high or 0
        if (high - low + 2) * known.most < 1 << 62:
            key = F.coalesce(F.col("doc_id").cast("long") - F.lit(low) + 1, F.lit(0)) * known.most + F.col("number")
    return rows.select("doc_id", "size", "crc", key.alias("key"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, and the columns in ``keep``.

    Shards are ranges of (CRC of text, doc_id) with near equal sums of size; slots count from 0 in that order without
    gaps. Equal texts are neighbours, and so share a shard but where a splitter falls among them. Null texts have size 16
    and CRC 0; a null doc_id sorts first. Rows equal in text and doc_id are counted and numbered, so that they can be
    parted as well; only where columns are kept, or the span of ids times the most copies passes 2^62, they stay in one
    shard. Other columns, whatever their names, don't matter. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)))
    base = docs.select("doc_id", (F.length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("crc"), low.alias("key"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    keys = put_table(base.select("doc_id", "size", "crc", "key") if keep else _numbered(base), "shard-keys")
    n = keys.count()
    fine = max(1, min(PIECES // shards, -(-n // (shards * TASK_ROWS))))
    bounds, below = splitters(keys, shards, tolerance, fine)
    source = keys if not keep else base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, key = batch.column("crc").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
            piece = _buckets(crc, key, bounds) if bounds else np.zeros(len(crc), np.int64)
            yield pa.record_batch([*batch.columns, pa.array(piece.astype(np.int32))], names=[*batch.schema.names, "piece"])

    from pyspark.sql.types import IntegerType, StructType

    pieces = source.mapInArrow(run, StructType([*source.schema.fields]).add("piece", IntegerType()))
    starts = np.concatenate([[0], below]) if len(below) else np.zeros(shards * fine, np.int64)
    first = starts - np.repeat(starts[::fine], fine)  # slots before each piece in its shard
    offsets = docs.sparkSession.createDataFrame([(i, int(f)) for i, f in enumerate(first.tolist())], "piece int, before long")
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("crc", "key", "size"))
    return pieces.withColumn("rank", rank).join(F.broadcast(offsets), "piece").select(  # offsets: a row for each piece, PIECES or ``shards`` at most
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.floor(F.col("piece") / fine).cast("int").alias("shard"), (F.col("rank") - 1 + F.col("before")).cast("long").alias("slot"), *[F.col(f"kept_{c}").alias(c) for c in keep]
    )


def op2_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents by the law ``bytes``: nulls, empty and long texts, ties, repeats and empty tables as in ``assign_shards``."""
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
