"""Relational operators: interval, as-of and division joins, ranks, runs, dictionaries, nesting and upserts.

All are compositions of DataFrame operations, so that Catalyst plans them; none collects rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], on: str, take: list[str], tie: str = "tie") -> DataFrame:
    """Each left row with the columns ``take`` of the last right row of its keys whose ``on`` is not greater.

    One union and one window instead of a range join: right rows sort before left rows at equal ``on``, and ``tie``
    (a column of right, larger wins) decides among right rows.
    """
    names = [c for c in left.columns if c not in keys and c != on]
    a = left.select(*keys, on, F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), *names, *[F.lit(None).cast(right.schema[c].dataType).alias(f"_{c}") for c in take])
    b = right.select(*keys, on, F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], *[F.col(c).alias(f"_{c}") for c in take])
    w = Window.partitionBy(*keys).orderBy(on, "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b)
    for c in take:
        both = both.withColumn(c, F.last(f"_{c}", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*keys, on, *names, *take)


def best_overlap(left: DataFrame, right: DataFrame, key: str, same: Column, order: list[Column], band: float) -> DataFrame:
    """Each left interval (top, bottom) with the right interval of its key that overlaps it best: same class first, then the longest overlap.

    Intervals are copied to every band of width ``band`` that they touch and meet there, so that a key with very many
    layers doesn't pair them all; a pair counts in the first band of both. The result is the same for every width.
    """
    r = right.select(F.col(key).alias("_k"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])

    def banded(df: DataFrame, top: str, bottom: str, first: str) -> DataFrame:
        edges = df.where(F.col(bottom) > F.col(top)).withColumn(first, F.floor(F.col(top) / band))
        return edges.withColumn("_band", F.explode(F.sequence(first, F.greatest(first, F.ceil(F.col(bottom) / band) - 1))))

    a, b = banded(left, "top", "bottom", "_first"), banded(r, "r_top", "r_bottom", "_r_first").withColumnRenamed("_band", "_b")
    overlap = F.least("bottom", "r_bottom") - F.greatest("top", "r_top")
    met = a.join(b, (F.col(key) == F.col("_k")) & (F.col("_band") == F.col("_b"))).where((overlap > 0) & (F.col("_band") == F.greatest("_first", "_r_first")))
    both = met.withColumn("overlap", overlap).withColumn("same_class", same.cast("int"))
    w = Window.partitionBy(key, "top", "bottom").orderBy(F.desc("same_class"), F.desc("overlap"), *order)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_k", "_band", "_b", "_first", "_r_first")


def divide(df: DataFrame, candidate: str, member: str, members: int) -> DataFrame:
    """Candidates that have a row for every one of ``members`` distinct members (relational division)."""
    return df.groupBy(candidate).agg(F.countDistinct(member).alias("_n")).where(F.col("_n") == members).select(candidate)


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], weight: str | None = None) -> DataFrame:
    """sorted[round_half_even(q * (n - 1))] of each key, one row with a column for each quantile.

    Equal values are counted first (``weight``: how often a row counts), so that a window sees distinct values alone.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("_to", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    def at(q: float) -> Column:
        rank = F.bround(F.lit(q) * (F.col("_n") - 1))
        return (rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_c"))

    return ranked.groupBy(*keys).agg(*[F.max(F.when(at(q), F.col(value))).alias(name) for name, q in quantiles.items()])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def runs(df: DataFrame, keys: list[str], order: list[str], changes: Column, name: str = "run") -> DataFrame:
    """Numbers runs (gaps and islands): a new one begins where ``changes`` is true or at the first row of a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.coalesce(changes.cast("int"), F.lit(1))).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def previous(value: str, keys: list[str], order: list[str]) -> Column:
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))


def previous_known(value: str, keys: list[str], order: list[str]) -> Column:
    """The last value before the row that isn't null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def dictionary(df: DataFrame, value: str, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """Distinct values numbered from 0 by first appearance. Only the distinct values are ranked together."""
    keys = scope or []
    first = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("code", (F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1).cast("long")).drop("_first")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key ``new`` lacks, and all of ``new``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def share(value: Column, over: list[str]) -> Column:
    """Percent of the total; a total of 0 counts as 1."""
    total = F.sum(value).over(Window.partitionBy(*over))
    return F.lit(100.0) * value / F.coalesce(F.nullif(total, F.lit(0)), F.lit(1))


def nest(df: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """One row for each key with its rows as an ordered array of structs."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def tree_digest(df: DataFrame, keys: list[str], order: str, digest: str, fan: int, levels: int) -> DataFrame:
    """keys and one digest each: digests are joined in order of a whole number, ``fan`` neighbours at a time, and digested, ``levels`` times before the last.

    A row holds ``fan`` digests, and the last one those of numbers that share no higher part: levels enough for the largest
    number, so that fan ** (levels + 1) is above it, bound that too.
    """
    for level in range(levels + 1):
        above = [] if level == levels else [F.floor(F.col(order) / fan).alias("_up")]
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda x: x[digest]), "")
        df = df.groupBy(*keys, *above).agg(F.sha2(joined, 256).alias(digest))
        df = df if level == levels else df.withColumnRenamed("_up", order)
    return df
