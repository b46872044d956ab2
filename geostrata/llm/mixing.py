"""Mixing sources to target weights by the cube method.

Each source's target is a share of the mix by weight, stopped at a multiple of the
source's size. Every document is taken the whole times that the source's rate gives;
the fractional rest is an inclusion probability. The flight phase moves the
probabilities through the null space of the constraints (documents and words stay in
balance) until nearly all are 0 or 1: first in blocks of each source, then among what
blocks leave, until one block a source remains. It settles the largest document that is
open by moving all others a little, so that what stays open is small. In the last block
the smallest documents land with what the flight leaves: probabilities are parted into
samples with shares, nearest to the balance first, and one is drawn by its share. No
document's inclusion probability changes on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.llm.common import chunks, put_table, table, text_bytes

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
#: Units of a flight.
BLOCK = 1024
#: Units that a block keeps out of its flight for the next one, and the smallest of the last block, which land together.
RESERVE = 12
SEED = 20240229
_EPS = 1e-9


def shares(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_no, source_size, n, target and rate (target by size) of the sources in ``sizes`` (source, size, n).

    Sources by code point, null last, weigh by turns; a target stops at cap times the size and the rest is shared anew
    until none is above. All steps are aggregates over the sources, of which there may be many.
    """
    place = F.monotonically_increasing_id()
    ordered = put_table(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("place", place), "mix-sources")
    part = F.shiftright("place", 33)
    counts = ordered.groupBy(part.alias("part")).count().collect()  # a row for each partition of the sort
    before, total = [], 0
    for r in sorted(counts, key=lambda r: r.part):
        before.append((r.part, total))
        total += r["count"]
    offsets = ordered.sparkSession.createDataFrame(before, "part long, before long")
    number = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    numbered = ordered.withColumn("part", part).join(F.broadcast(offsets), "part").select("source", number.alias("source_no"), F.col("size").alias("source_size"), "n", weight.alias("weight"))
    # a source is full if its share at this many words a weight passes its cap; the others share what full ones leave
    most = F.col("source_size") * F.lit(cap)
    left, level, full = None, 0.0, -1
    while True:
        is_full = F.lit(level) * F.col("weight") > most
        got = numbered.agg(F.sum("source_size").alias("all"), F.count_if(is_full).alias("full"), F.sum(F.when(is_full, most)).alias("taken"), F.sum(F.when(~is_full, F.col("weight"))).alias("free")).first()
        left = share * (got["all"] or 0) - (got.taken or 0.0)
        if got.full == full or not got.free:
            break
        full, level = got.full, left / got.free
    target = F.when(F.lit(level) * F.col("weight") > most, most).otherwise(F.lit(level) * F.col("weight"))
    return numbered.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).drop("weight")


def fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase over one block: probabilities after it, at most two of them neither 0 nor 1 (one, if all sizes are equal); sums of p and of p * size stay.

    Each step moves the largest open unit, or where the others can't make up for it the next, and all smaller ones so
    much as the balance asks, those near 0 or 1 the least.
    """
    order = np.argsort(-size, kind="stable")
    s, x = size[order].astype(float), p[order].astype(float)
    open_ = np.flatnonzero((x > _EPS) & (x < 1 - _EPS))
    while len(open_) > 1:
        own, at = s[open_], x[open_]
        u = np.zeros(len(open_))
        for pivot in range(len(open_) - 1):
            rest, weight = own[pivot + 1 :], (at * (1 - at))[pivot + 1 :]
            mean = float(weight @ rest / weight.sum())
            spread = float(weight @ (rest - mean) ** 2)
            if rest[0] > rest[-1] and spread > 0:
                move = -weight * (1 / weight.sum() + (own[pivot] - mean) / spread * (rest - mean))
            elif own[pivot] == rest[0] == rest[-1]:
                move = -weight / weight.sum()
            else:  # equal units can't make up for one of another size
                continue
            u[pivot], u[pivot + 1 :] = 1.0, move
            break
        else:
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            up = float(np.min(np.where(u > 0, (1 - at) / u, np.where(u < 0, at / -u, np.inf))))
            down = float(np.min(np.where(u > 0, at / u, np.where(u < 0, (1 - at) / -u, np.inf))))
        x[open_] = at + u * (up if rng.random() * (up + down) < down else -down)
        open_ = open_[(x[open_] > _EPS) & (x[open_] < 1 - _EPS)]
    x[x <= _EPS], x[x >= 1 - _EPS] = 0.0, 1.0
    out = np.empty(len(x))
    out[order] = x
    return out


def hold(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight of all but the last RESERVE open units, which stay as they are."""
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    out = p.copy()
    flown = np.setdiff1d(np.arange(len(p)), open_[-RESERVE:])
    out[flown] = fly(size[flown], p[flown], rng)
    return out


def samples_of(size: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, shares) of a few units: shares sum to 1 and give every unit its probability; each sample has the expected number of units, but for rounding.

    Of the samples that agree with what is left to part, the one nearest to the words' balance gets as much as it can
    without leaving a unit more, or less, than the rest can give. Every step settles a unit, so that they end.
    """
    n = len(p)
    all_ = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool)
    least = int(np.floor(p.sum() + _EPS))
    over = all_.sum(axis=1) - least
    # one more column: whether the sample has one unit more than the least
    valid = (over >= 0) & (over <= (p.sum() - least > _EPS))
    rows = np.concatenate([all_[valid], (over[valid] == 1)[:, None]], axis=1)
    far = np.abs(rows[:, :n] @ size.astype(float) - float(size @ p))
    rows = rows[np.argsort(far, kind="stable")]
    left, mass = np.append(p, max(0.0, p.sum() - least)), 1.0
    chosen, parts = [], []
    while mass > _EPS:
        fits = ~(rows & (left <= _EPS)).any(axis=1) & ~(~rows & (left >= mass - _EPS)).any(axis=1)
        if not fits.any():  # what is left is rounding
            break
        row = rows[int(np.argmax(fits))]
        part = float(np.where(row, left, mass - left).min())
        chosen.append(row[:n])
        parts.append(part)
        left = np.where(row, left - part, left)
        mass -= part
    return np.array(chosen).reshape(len(chosen), n), np.array(parts)


def land(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight of all but the RESERVE smallest open units, then landing of those and of what it leaves: one of their samples is drawn by its share."""
    out = p.astype(float)
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    small = open_[np.argsort(size[open_], kind="stable")[:RESERVE]]
    flown = np.setdiff1d(np.arange(len(p)), small)
    out[flown] = fly(size[flown], p[flown], rng)
    left = np.flatnonzero((out > _EPS) & (out < 1 - _EPS))
    if len(left):
        samples, parts = samples_of(size[left], out[left])
        ends = np.cumsum(parts)
        out[left] = samples[min(int(np.searchsorted(ends, rng.random() * ends[-1], "right")), len(ends) - 1)]
    return np.rint(out)


def _flight(seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "key_a", "key_b", "unit"], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, int(key[0]), int(key[1])])
        rows["p"] = (land if rows["blocks"].iloc[0] == 1 else hold)(rows["size"].to_numpy(), rows["p"].to_numpy(), rng)
        return rows

    return run


def keys_of(doc_id: Column, text: Column, source: Column) -> tuple[Column, Column]:
    """128 bits, never null, that tell rows apart by id, text and source."""
    values = [F.coalesce(doc_id.cast("string"), F.lit("\x00")), F.coalesce(text, F.lit("\x00")), F.coalesce(source, F.lit("\x00"))]
    return F.xxhash64(*values), F.xxhash64(F.lit("b"), *values)


def mix_units(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """As ``mix_sources``, with ``key_a`` and ``key_b`` (``keys_of``) of each row and its number among rows of equal keys (``unit``)."""
    if block < 3 * RESERVE:  # blocks must leave fewer units than they hold
        raise ValueError(f"blocks of under {3 * RESERVE} units")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            n = [len(t.split()) for t in text_bytes(batch.column("text"))]
            yield pa.record_batch([*batch.columns[:-1], pa.array(n, pa.int64())], names=["doc_id", "source", "key_a", "key_b", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    a, b = keys_of(F.col("doc_id"), F.col("text"), F.col("source"))
    sized = narrow.select("doc_id", "source", a.alias("key_a"), b.alias("key_b"), "text").mapInArrow(count, f"doc_id {kind}, source string, key_a long, key_b long, size long")
    # equal rows are counted and dealt out again by number, so that they get blocks of their own
    same = put_table(sized.groupBy("doc_id", "source", "key_a", "key_b", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    plan = put_table(shares(same.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.sum("rows").alias("n")), weights, share, cap), "mix-plan")
    step = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / 1024)))
    units = same.withColumn("step", step).withColumn("unit", F.explode(F.sequence(F.col("step") * 1024, F.least(F.col("rows"), F.col("step") * 1024 + 1024) - 1)))
    whole = F.floor(F.col("rate") + F.lit(1e-12))
    open_ = (
        units.join(plan.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
        .withColumn("turn", F.xxhash64("key_a", "key_b", "unit", F.lit(seed)))
        .select("source_no", "doc_id", "size", "turn", F.greatest(F.lit(0.0), F.col("rate") - whole).alias("p"), "source", "source_size", "target", whole.alias("whole"), "key_a", "key_b", "unit", "n")
    )
    done, rounds = [], 0
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long")
        dealt = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key_a", "key_b", "unit", F.lit(seed + 1 + rounds)), F.col("blocks"))).drop("n")
        flown = put_table(dealt.groupBy("source_no", "block").applyInPandas(_flight(seed + rounds), dealt.schema), f"mix-flight{rounds}")
        done.append(flown.where("p in (0, 1)"))
        left = flown.where("p not in (0, 1)").drop("blocks", "block")
        counts = put_table(left.groupBy("source_no").agg(F.count("*").alias("n")), f"mix-left{rounds}")
        rounds += 1
        if not counts.limit(1).count():
            break
        open_ = left.join(counts, "source_no").select(open_.columns)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    times = F.col("whole") + F.rint("p").cast("long")
    return out.select("doc_id", "size", "source", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), "key_a", "key_b", "unit")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, size (words), source, source_size, target, times (whole copies to take) and taken (words) of every row.

    Null and empty texts have size 0. Null sources are one source, last in the order. The same rows give the same
    mix however they are partitioned. Repeated rows are units of their own; which of them is taken makes no difference.
    Units of equal size have equal chances whatever their order. Other columns, whatever their names, don't matter. An
    empty table gives an empty mix.
    """
    return mix_units(docs, weights, share, cap, seed, block).drop("key_a", "key_b", "unit")


def take(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Each row of ``docs`` as many times as the mix takes it.

    Of rows equal in id, text and source the mix says how many are taken once more than the others; those that come first
    by their other columns are. Null ids, texts and sources are values like others. An empty table stays empty.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of the input clashes with those below
    doc_id, text, source = (f"c{names.index(c)}" for c in ("doc_id", "text", "source"))
    a, b = keys_of(F.col(doc_id), F.col(text).cast("string"), F.col(source).cast("string"))
    units = mix_units(docs, seed=seed)
    times = put_table(units.groupBy("key_a", "key_b").agg(F.min("times").alias("least"), F.sum("times").alias("sum"), F.count("*").alias("rows")), "mix-times")
    # equal rows are counted before the exchange and told apart by their number alone
    counted = plain.withColumn("key_a", a).withColumn("key_b", b).groupBy("key_a", "key_b", *plain.columns).agg(F.count("*").alias("equal"))
    both = counted.join(times.where("sum > 0").hint("merge"), ["key_a", "key_b"])
    order = Window.partitionBy("key_a", "key_b").orderBy(*[c for c in plain.columns if c != text])
    before = F.sum("equal").over(order.rowsBetween(Window.unboundedPreceding, -1))
    more = F.col("sum") - F.col("least") * F.col("rows") - F.coalesce(before, F.lit(0))
    copies = F.col("least") * F.col("equal") + F.greatest(F.lit(0), F.least(more, F.col("equal")))
    # a step of copies at a time, so that no row of the plan makes an array of all
    step = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 1024)))
    taken = both.withColumn("copies", copies).where("copies > 0").withColumn("step", step)
    taken = taken.withColumn("copy", F.explode(F.sequence(F.col("step") * 1024, F.least(F.col("copies"), F.col("step") * 1024 + 1024) - 1)))
    return taken.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op9_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: nulls, empty and long texts, ties, repeats and empty tables as in ``mix_sources``."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
