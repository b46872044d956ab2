"""Hard negatives by a pivot table.

Vectors become integers. Rows get one more component, so that all are equally long, and
anchors a zero there; the rows with the largest inner product with an anchor are then the
nearest to it. A table keeps every row's distances to a few pivots. By the triangle
inequality the distances of anchor and row to a pivot bound the distance between the two
from both sides, and so bracket their score. Rows whose bracket can't hold a wanted score are passed over, blocks
of neighbouring rows at once where their ranges of distances allow it; all others are
checked by their exact score.

Anchors come in blocks of bounded size. Two scans over all rows answer a block: one for
the positives, one for the negatives in the bands that the positives set. Every task
keeps the best few of each anchor and positive, so that the exchange after a scan doesn't
grow with the table's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.llm.common import put_table, size_in_bytes, table

#: Positives of an anchor, negatives of a positive, and their scores' least and greatest share of the positive's, in percent.
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Pivots, and rows (those with the smallest hashes) that pivots and first bounds are taken from; every row is in the table.
PIVOTS, SAMPLE = 12, 1024
#: Anchors of a block, rows whose distances are bounded together, pairs that are bracketed at once.
BLOCK, TOGETHER, PAIRS = 32768, 256, 1 << 21
#: Bytes of stored rows to a range of neighbouring ones.
RANGE_BYTES = 32 << 20
#: Largest squared length: up to it sums of products are exact in doubles.
EXACT = 2.0**53
#: Share of the squared length that roundings of brackets stay below.
SLACK = 1e-5
NO_ID = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min


def integer_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (integers) of the rows that take part; where vec_id is divisible by 7 the label is the next one."""
    e = F.col("embedding").cast("array<double>")
    whole = F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(e, lambda x: F.floor(x * 256.0)).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    """Equally long lists as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(NO_ID).cast(pa.int64()).to_numpy(zero_copy_only=False)


def farthest_first(sample: np.ndarray, squared: float, count: int = PIVOTS) -> np.ndarray:
    """Pivots, as lengthened vectors: the first row, then each time the one farthest from all before."""
    longer = lengthened(sample, squared)
    chosen, gap = [], np.full(len(longer), np.inf)
    at = 0
    for _ in range(min(count, len(longer))):
        chosen.append(longer[at])
        gap = np.minimum(gap, ((longer - longer[at]) ** 2).sum(axis=1))
        at = int(np.argmax(gap))
    return np.array(chosen).reshape(len(chosen), sample.shape[1] + 1)


def lengthened(v: np.ndarray, squared: float) -> np.ndarray:
    """Rows with a further component that makes them all as long as the longest."""
    return np.concatenate([v, np.sqrt(np.maximum(0.0, squared - (v**2).sum(axis=1)))[:, None]], axis=1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)).astype(np.float32)


class Brackets:
    """Bounds on the scores of anchors and rows by their distances to pivots."""

    def __init__(self, lengths: np.ndarray, far: np.ndarray, squared: float):
        self.both, self.far, self.slack = lengths + squared, far, SLACK * squared + 1.0  # squared lengths of anchor and row together

    def of_block(self, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds, for each anchor, of the scores of rows with distances from ``least`` to ``most``."""
        near = np.maximum(0, np.maximum(self.far - most, least - self.far)).max(axis=1, initial=0)
        away = (self.far + most).min(axis=1, initial=np.inf)
        return self.bounds(near.astype(float), away.astype(float), self.both)

    def of_pairs(self, anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of each of ``anchors`` (numbers) with each of ``rows`` (distances)."""
        own = self.far[anchors]
        near, away = np.zeros((len(own), len(rows)), np.float32), np.full((len(own), len(rows)), np.inf, np.float32)
        for p in range(own.shape[1]):
            a, r = own[:, p, None], rows[None, :, p]
            np.maximum(near, np.abs(a - r), out=near)
            np.minimum(away, a + r, out=away)
        return self.bounds(near, away, self.both[anchors][:, None])

    def bounds(self, near: np.ndarray, away: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (both - away.astype(float) ** 2) / 2 - self.slack, (both - near.astype(float) ** 2) / 2 + self.slack


class Best:
    """The best few rows of each slot: by score, then vec_id, then uid."""

    def __init__(self, least: np.ndarray, few: int):
        self.least, self.few = least.copy(), few
        self.kept: list[np.ndarray] = [np.empty((4, 0), np.int64)]  # slot, score, vec_id, uid
        self.held = 0

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, uid: np.ndarray) -> None:
        good = score >= self.least[slot]
        if good.any():
            self.kept.append(np.stack([slot[good], score[good], vec_id[good], uid[good]]))
            self.held += int(good.sum())
            if self.held > 4 * self.few * len(self.least) + 65536:
                self.reduced()

    def reduced(self) -> np.ndarray:
        rows = np.concatenate(self.kept, axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0], "left")
        place = np.arange(rows.shape[1]) - first
        full = place == self.few - 1
        np.maximum.at(self.least, rows[0][full], rows[1][full])
        rows = rows[:, place < self.few]
        self.kept, self.held = [rows], 0
        return rows


class Anchors:
    """A block of anchors, as tasks get it: vectors, labels, uids, distances; for negatives also the positives' scores, a row an anchor, with LOWEST where there are fewer."""

    def __init__(self, got: pa.Table, squared: float, positives: bool):
        self.v, self.label, self.uid = matrix(got["v"]), numbers(got["label"]), numbers(got["uid"])
        self.least = numbers(got["least"]) if positives else matrix(got["least"], np.int64)
        self.squared, self.positives = squared, positives
        self.far = matrix(got["far"], np.float32)
        if not positives:
            self.score = matrix(got["scores"], np.int64)
            real = self.score != LOWEST
            # 50 p <= 100 n <= 95 p, in whole numbers
            self.low = np.where(real, -((-LOW * np.where(real, self.score, 0)) // 100), NO_ID)
            self.high = np.where(real, (HIGH * np.where(real, self.score, 0)) // 100, LOWEST)

    def slots(self) -> int:
        return len(self.uid) * (1 if self.positives else POSITIVES)

    def search(self, batches: Iterator[tuple[np.ndarray, ...]]) -> Best:
        """Best rows of each slot among ``batches`` of (vec_id, uid, label, v, far)."""
        best = Best(self.least.ravel(), POSITIVES if self.positives else NEGATIVES)
        bounds = Brackets((self.v**2).sum(axis=1), self.far, self.squared)
        for vec_id, uid, label, v, far in batches:
            for i in range(0, len(uid), TOGETHER):
                part = slice(i, i + TOGETHER)
                self._block(best, bounds, vec_id[part], uid[part], label[part], v[part], far[part])
        return best

    def wanted(self, best: Best) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score, of each anchor, that could still be among the best."""
        if self.positives:
            return best.least.astype(float), np.full(len(self.uid), np.inf)
        least = np.maximum(self.low, best.least.reshape(-1, POSITIVES))
        return np.where(least <= self.high, least, NO_ID).min(axis=1).astype(float), self.high.max(axis=1).astype(float)

    def _block(self, best: Best, bounds: Brackets, vec_id: np.ndarray, uid: np.ndarray, label: np.ndarray, v: np.ndarray, far: np.ndarray) -> None:
        low, high = self.wanted(best)
        lower, upper = bounds.of_block(far.min(axis=0), far.max(axis=0))
        alive = np.flatnonzero((upper >= low) & (lower <= high))
        for i in range(0, len(alive), max(1, PAIRS // len(uid))):
            some = alive[i : i + max(1, PAIRS // len(uid))]
            lower, upper = bounds.of_pairs(some, far)
            same = self.label[some][:, None] == label[None, :]
            keep = (upper >= low[some][:, None]) & (lower <= high[some][:, None]) & (same == self.positives)
            a, r = np.nonzero(keep)
            if not len(a):
                continue
            if 8 * len(a) > keep.size:
                score = (self.v[some] @ v.T)[a, r]
            else:
                score = np.einsum("ij,ij->i", self.v[some[a]], v[r])
            a, score = some[a], score.astype(np.int64)
            if self.positives:
                other = self.uid[a] != uid[r]
                best.add(a[other], score[other], vec_id[r[other]], uid[r[other]])
            else:
                for k in range(POSITIVES):
                    fits = (score >= self.low[a, k]) & (score <= self.high[a, k])
                    best.add(a[fits] * POSITIVES + k, score[fits], vec_id[r[fits]], uid[r[fits]])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        if b.num_rows:
            yield numbers(b["vec_id"]), numbers(b["uid"]), numbers(b["label"]), matrix(b["v"]), matrix(b["far"], np.float32)


INDEX = "vec_id long, uid long, label long, v array<bigint>, far array<float>"


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, pa.Table, object, float]:
    """(index, sample, pivots, largest squared length): all rows with their distances to the pivots, neighbours together, and the sample's rows.

    Pivots are chosen from ``sample`` rows at most; each row's place in the index is that of its nearest pivot and the distance to it.
    """
    rows = put_table(integer_rows(vectors), "neg-rows")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    known = rows.agg(F.max(length).alias("squared"), F.max(F.size("v")).alias("size")).first()
    squared, size = known.squared or 0.0, max(1, known["size"] or 0)
    if squared >= EXACT:
        raise ValueError("vectors are too long for exact scores")
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v")))
    rows = rows.select("vec_id", F.monotonically_increasing_id().alias("uid"), "label", filled.alias("v"))
    drawn = rows.orderBy(F.xxhash64("v", "vec_id"), "uid").limit(sample).toArrow()
    chosen = farthest_first(matrix(drawn["v"]) if drawn.num_rows else np.zeros((0, size)), squared, pivots)
    told = vectors.sparkSession.sparkContext.broadcast(chosen)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far = np.concatenate([distances(lengthened(matrix(b["v"].slice(i, 1024)), squared), told.value) for i in range(0, b.num_rows, 1024)])
                yield pa.record_batch([*b.columns, _lists(far)], names=["vec_id", "uid", "label", "v", "far"])

    measured = rows.mapInArrow(measure, INDEX)
    nearest = F.array_min("far")
    place = [F.array_position("far", nearest), nearest, F.col("uid")]
    kept = put_table(measured, "neg-distances")  # else the sampling for ranges would measure all anew
    index = put_table(kept.repartitionByRange(max(1, -(-size_in_bytes(kept) // RANGE_BYTES)), *place).sortWithinPartitions(*place), "neg-index")
    own = _lists(distances(lengthened(matrix(drawn["v"]), squared), chosen)) if drawn.num_rows else pa.array([], pa.list_(pa.float32()))
    return index, drawn.append_column("far", own), told, squared


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def _asked(pivots):
    """Of rows as anchors: their distances to the pivots when the further component is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b["v"])
                far = np.concatenate([distances(np.pad(v[i : i + 1024], ((0, 0), (0, 1))), pivots.value) for i in range(0, len(v), 1024)])
                yield pa.record_batch([*b.columns[:-1], _lists(far)], names=b.schema.names)

    return run


def _seeded(positives: bool, sample, squared: float):
    """Adds ``least``: the score that as many rows of the sample reach, of each anchor (and positive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            slots = b.num_rows * (1 if positives else POSITIVES)
            first = np.full(slots, LOWEST)
            t = pa.Table.from_batches([b]).append_column("least", pa.array(first) if positives else _lists(first.reshape(-1, POSITIVES)))
            best = Anchors(t, squared, positives).search(unpacked(sample.value.to_batches()))
            best.reduced()
            yield pa.record_batch([*b.columns, pa.array(best.least) if positives else _lists(best.least.reshape(-1, POSITIVES))], names=[*b.schema.names, "least"])

    return run


def _found(index: DataFrame, block, few: int) -> DataFrame:
    """slot, score, vec_id and uid of the best ``few`` rows of each slot of a broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = block.value.search(unpacked(batches)).reduced()
        if rows.shape[1]:
            vec_id = pa.array(rows[2], mask=rows[2] == NO_ID)
            yield pa.record_batch([pa.array(rows[0]), pa.array(rows[1]), vec_id, pa.array(rows[3])], names=["slot", "score", "vec_id", "uid"])

    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return index.mapInArrow(run, "slot long, score long, vec_id long, uid long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= few)


def hard_negatives(vectors: DataFrame, anchors: Column | None = None, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every anchor's positives and their hard negatives.

    vectors: vec_id, embedding, label. Rows with a null label, a null vector or a component that is null or not finite
    take no part; shorter vectors are filled up with zeros. Anchors (by default rows whose vec_id divides by 50; a null
    id never) have as positives the first ``POSITIVES`` other rows of their label, each positive as negatives the first
    ``NEGATIVES`` rows of other labels whose score is between ``LOW`` and ``HIGH`` percent of its own. Ties go to the
    smaller vec_id, null last. A repeated row is a row of its own, also beside its equal. Without a fitting row there is
    none in the result. Other columns, whatever their names, don't matter. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index, sample, pivots, squared = pivot_table(vectors.select("vec_id", "embedding", "label"))
    chosen = index.where(F.col("vec_id") % 50 == 0 if anchors is None else anchors)
    if not sample.num_rows:
        return spark.createDataFrame([], result)
    drawn = spark.sparkContext.broadcast(sample)
    asked = put_table(chosen.mapInArrow(_asked(pivots), INDEX).mapInArrow(_seeded(True, drawn, squared), f"{INDEX}, least long"), "neg-anchors")
    blocks = max(1, -(-asked.count() // block))
    done = [_block(index, asked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b), drawn, squared, b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, done)


def _block(index: DataFrame, asked: DataFrame, drawn, squared: float, number: int) -> DataFrame:
    """The result for one block of anchors: they and their positives go to the driver, of bounded number, and from there to all tasks."""
    spark = index.sparkSession
    got = asked.toArrow()
    sent = spark.sparkContext.broadcast(Anchors(got, squared, True))
    slots = pa.table({"slot": pa.array(np.arange(got.num_rows)), "anchor": got["uid"]})
    positives = put_table(_found(index, sent, POSITIVES), f"neg-positives{number}")
    fewer = F.slice(F.concat(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]), F.array_repeat(F.lit(LOWEST), POSITIVES)), 1, POSITIVES)
    scores = positives.groupBy("slot").agg(fewer.alias("scores"))
    named = spark.createDataFrame(slots).join(asked.drop("least").withColumnRenamed("uid", "anchor"), "anchor")
    with_scores = named.join(scores, "slot").select("vec_id", F.col("anchor").alias("uid"), "label", "v", "far", "scores", "slot")
    bands = with_scores.mapInArrow(_seeded(False, drawn, squared), f"{INDEX}, scores array<bigint>, slot long, least array<bigint>").toArrow()
    sent.destroy()
    again = spark.sparkContext.broadcast(Anchors(bands, squared, False))
    found = put_table(_found(index, again, NEGATIVES), f"neg-found{number}")
    again.destroy()
    k = pa.table({"slot": bands["slot"], "row": pa.array(np.arange(bands.num_rows)), "anchor_id": bands["vec_id"]})
    numbered = spark.createDataFrame(k)
    own = positives.join(numbered, "slot").select((F.col("row") * POSITIVES + F.col("rank") - 1).alias("slot"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(own, "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors in ``embeddings``: nulls, odd vectors, ties, repeats and empty tables as in ``hard_negatives``."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


#: All pairs of an anchor and a row, in whole numbers.
ORACLE_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
