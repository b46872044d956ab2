"""Runs of repeating words, found by counting matches at every lag.

A run of period q is a stretch whose words q apart are identical; within it, the words
match at lag q throughout. So a lag can only be a run's period if the whole text has at
least as many matches at that lag as the shortest run needs. Matches at all lags are
counted exactly: words that are frequent in the text by autocorrelation of their places
(FFT), rare ones by the differences of pairs of their places. Lags with enough matches,
and only those, are scanned for islands of matches, the smallest lag first; what a run
explains at multiples of its period is taken off their counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import chunks, table, text_bytes

#: Fewest words, and fewest periods, of a run.
WORDS, PERIODS = 24, 3
#: Complex numbers that are transformed at once.
AT_ONCE = 1 << 20


def need(lag: np.ndarray) -> np.ndarray:
    """Matches in a row that the shortest run of a period has."""
    return np.maximum(WORDS - lag, (PERIODS - 1) * lag)


def lag_counts(ids: np.ndarray, frequent: int | None = None) -> np.ndarray:
    """Number of i with ids[i] = ids[i + q], for each lag q up to a third of the text; exact.

    Words with more than ``frequent`` places (by default so many that either way costs about the same) go by FFT.
    """
    n = len(ids)
    most = n // PERIODS
    if frequent is None:
        frequent = max(16, int((n * max(1, n.bit_length())) ** 0.5) // 4)
    order = np.argsort(ids, kind="stable")
    sizes = np.bincount(ids)
    starts = np.cumsum(sizes) - sizes
    counts = np.zeros(most + 1, np.int64)
    light = np.flatnonzero((sizes > 1) & (sizes <= frequent))
    if len(light):
        own = sizes[light]
        by = np.argsort(-own, kind="stable")
        light, own = light[by], own[by]
        held, size = [], 0
        for k in range(1, int(own[0])):  # the k-th next place of the same word
            words = light[: int(np.searchsorted(-own, -k, "left"))]  # those with more than k places
            span = sizes[words] - k
            at = np.repeat(starts[words] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
            held.append(order[at + k] - order[at])
            size += len(at)
            if size > AT_ONCE or k == own[0] - 1:
                lags = np.concatenate(held)
                counts += np.bincount(lags[lags <= most], minlength=most + 1)
                held, size = [], 0
    heavy = np.flatnonzero(sizes > frequent)
    if len(heavy):
        size = 1 << int(n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        rows = max(1, AT_ONCE // size)
        for i in range(0, len(heavy), rows):
            part = heavy[i : i + rows]
            places = np.zeros((len(part), size))
            for row, w in enumerate(part.tolist()):
                places[row, order[starts[w] : starts[w] + sizes[w]]] = 1.0
            f = np.fft.rfft(places, axis=1)
            power += (f.real**2 + f.imag**2).sum(axis=0)
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    return counts


def _reach(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """Matches in a row from ``at`` on (step 1) or up to and with it (step -1)."""
    n, total, size = len(ids) - lag, 0, 32
    while True:
        if step > 0:
            a = at + total
            b = min(n, a + size)
        else:
            b = at + 1 - total
            a = max(0, b - size)
        if a >= b:
            return total
        missed = np.flatnonzero(ids[a:b] != ids[a + lag : b + lag])
        if len(missed):
            return total + int(missed[0] if step > 0 else b - a - 1 - missed[-1])
        total += b - a
        size = min(size * 4, 1 << 16)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period; ids: small numbers of the words."""
    n = len(ids)
    if n < WORDS:
        return []
    counts = lag_counts(ids)
    least = need(np.arange(len(counts)))
    counts[0] = 0
    found: list[tuple[int, int, int]] = []
    stretches: set[tuple[int, int]] = set()
    for q in np.flatnonzero(counts >= least).tolist():
        enough = int(least[q])
        if counts[q] < enough:  # runs of smaller periods have explained the rest
            continue
        # an island of so many matches holds one of these places, and half of its matches are on one side of it
        at = np.arange(0, n - q, enough)
        same = ids[at] == ids[at + q]
        at = at[same]
        for side in (1, 2, 3):
            if len(at) == 0:
                break
            right, left = np.minimum(at + side, n - q - 1), np.maximum(at - side, 0)
            at = at[(ids[right] == ids[right + q]) | (ids[left] == ids[left + q])]
        passed = -1
        for p in at.tolist():
            if p <= passed:
                continue
            ahead = _reach(ids, p, q, 1)
            behind = _reach(ids, p, q, -1)
            start, end = p - behind + 1, p + ahead + q
            passed = p + ahead - 1
            if ahead + behind - 1 < enough or (start, end) in stretches:
                continue
            found.append((start, end - start, q))
            stretches.add((start, end))
            # at multiples of its period the run's own matches are one island, its whole stretch, and no run
            explained = (end - start) - np.arange(2 * q, len(counts), q)
            counts[2 * q :: q] -= np.maximum(explained, 0)
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as small numbers, equal where the words are."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text that is given a run on purpose; None if it is left as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, by start and period) and collapsed (the words that stay, joined by spaces) of each whole text.

    A run is a stretch of words with smallest period q, of at least max(24, 3 q) words, that can't be extended. Words are
    parted by ASCII white space. ``plant`` first repeats a part of some texts, which ones by id (a null id: never). Null
    and empty texts, and those of fewer words than a run has, have none. Repeated rows give repeated results. Other
    columns, whatever their names, don't matter. An empty table gives no rows.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            n_words, found, collapsed = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                words = text.split()
                ids = numbered(words)
                moved = planted(doc_id, len(words)) if plant and doc_id is not None else None
                if moved is not None:
                    words, ids = [words[i] for i in moved.tolist()], ids[moved]
                runs = runs_of(ids)
                if runs:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                n_words.append(len(ids))
                found.append([{"start": s, "length": k, "period": q} for s, k, q in runs])
                collapsed.append(b" ".join(words))
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(found, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, its strongest one, and digests of all runs and of the text without repeats: nulls, empty and long texts, ties, repeats and empty tables as in ``periodic_runs``."""
    found = periodic_runs(table(spark, sf_dir, "documents"), plant=True)

    # a product of lengths and periods compares exponents exactly; runs stand by start and period, so the first of equals stays
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", nothing, better)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    digested = found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return digested
