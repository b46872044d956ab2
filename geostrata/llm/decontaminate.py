"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a SimHash of its weighted word shingles (weight: how often a
shingle occurs). A document's windows of an item's length are fingerprinted alike; a
multi-index over blocks of the fingerprint returns every item within the radius: with m
blocks and bounds t_1 .. t_m whose sum is radius - m + 1, some block differs in at most its
bound. Exact weighted Jaccard similarity of the shingles then decides.

Windows that can't be similar enough are left out before they are fingerprinted, by an
exact bound: of equally many shingles, similarity t needs 2t / (1 + t) of them shared,
so a window with fewer shingles of items of its length can't pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from geostrata.llm.common import ALNUM, WordHash, chunks, mix, ranges, shingle_hashes, table, text_bytes

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, those that a similar window's may differ in, and blocks of the index. A window of similarity
#: 0.8 differs in 38 bits on average, with a deviation of 5.7: about one in a thousand such windows is further off, and
#: of more similar ones hardly any. The blocks' bounds let about one in 25 unrelated items through to the count of bits.
BITS, RADIUS, BLOCKS = 256, 56, 13
#: Text and number of the items whose index one pass carries: its size is bounded by these, whatever the benchmark's.
INDEX_BYTES, INDEX_ITEMS = 8 << 20, 1 << 16

_BIT = np.arange(64, dtype=np.uint64)
_SALTS = [np.uint64(0), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles from each start, in order, as rows of BITS booleans; a bit without majority is 0."""
    out = np.empty((len(starts), BITS), bool)
    far = np.flatnonzero(np.diff(starts) > size) + 1  # windows far apart are no reason to look at all between
    parts = [p for a, b in zip([0, *far.tolist()], [*far.tolist(), len(starts)], strict=True) for p in range(a, b, 1024) if b > a]
    for a, b in zip(parts, [*parts[1:], len(starts)], strict=True):
        low, high = int(starts[a]), int(starts[b - 1]) + size
        ones = np.concatenate([((mix(shingles[low:high] ^ salt)[:, None] >> _BIT) & np.uint64(1)).astype(np.int32) for salt in _SALTS], axis=1)
        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(ones, axis=0, dtype=np.int32)])
        out[a:b] = 2 * (sums[starts[a:b] - low + size] - sums[starts[a:b] - low]) > size
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles: sum of smaller over sum of larger weights."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(nx[i], ny[j]).sum())
    return shared / (len(a) + len(b) - shared)


@lru_cache(maxsize=64)
def _masks(width: int, bound: int) -> np.ndarray:
    """All values of ``width`` bits of which at most ``bound`` are set."""
    return np.array([sum(1 << b for b in c) for k in range(bound + 1) for c in combinations(range(width), k)], np.int64)


class Index:
    """Items grouped by number of words, the groups of each shingle, and a multi-index of fingerprints; arrays only, so that it is built once and sent as it is.

    An item has one entry for each block, and one for each of its distinct shingles.
    """

    def __init__(self, items: list[tuple[int, bytes]], radius: int = RADIUS, blocks: int = BLOCKS):
        hashed = WordHash()
        self.radius = radius
        sized = sorted(((len(w), item, shingle_hashes(w, SHINGLE)) for item, text in items if len(w := hashed.of(words(text)))), key=lambda x: x[0])
        self.ids, shingles = [x[1] for x in sized], [x[2] for x in sized]
        #: words and shingles of each group's items, and the number of each item's group; an item of fewer words than a shingle is one shingle of them all
        self.lengths, self.group = np.unique(np.array([x[0] for x in sized], np.int64), return_inverse=True)
        self.sizes = np.maximum(1, self.lengths - SHINGLE + 1)
        self.flat, self.ends = np.concatenate([np.empty(0, np.uint64), *shingles]), np.concatenate([[0], np.cumsum([len(x) for x in shingles], dtype=np.int64)])
        owner = np.repeat(self.group, np.diff(self.ends))
        order = np.lexsort((owner, self.flat))
        first = np.concatenate([[True], (np.diff(self.flat[order]) != 0) | (np.diff(owner[order]) != 0)])[: len(order)]
        self.pairs = self.flat[order][first], owner[order][first]  # distinct (shingle, group)
        self.known, self.at = np.unique(self.pairs[0], return_index=True)
        self.at = np.append(self.at, len(self.pairs[0]))
        self.prints = np.concatenate([np.empty((0, BITS), bool), *(fingerprints(s, np.zeros(1, np.int64), len(s)) for s in shingles)])
        self.packed = np.packbits(self.prints, axis=1).view(np.uint64)
        edges = np.arange(blocks + 1) * BITS // blocks
        total = radius - blocks + 1
        #: (first and last bit, bound, items' values by group and value, items) of each block
        self.blocks = []
        for b, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            bound = total // blocks + (b < total % blocks)
            values = self._value(self.prints, low, high)
            key = self.group << 32 | values
            order = np.argsort(key, kind="stable")
            self.blocks.append((low, high, bound, key[order], order))
        self._filters()

    def _filters(self) -> None:
        """Beginnings of shingles, and values of each block, that occur."""
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.known >> np.uint64(44)] = True
        self.occurs = []
        for low, high, _, keys, _ in self.blocks:
            self.occurs.append(np.zeros(1 << (high - low), bool))
            self.occurs[-1][keys & 0xFFFFFFFF] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("filter", "occurs")}  # made anew by each worker

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._filters()

    @staticmethod
    def _value(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return prints[:, low:high] @ (1 << np.arange(high - low, dtype=np.int64))

    def met(self, print_: np.ndarray, group: int) -> np.ndarray:
        """Items of a group of which some block is within its bound."""
        found = []
        for (low, high, bound, keys, items), occurs in zip(self.blocks, self.occurs, strict=True):
            if bound < 0:
                continue
            near = int(self._value(print_[None], low, high)[0]) ^ _masks(high - low, bound)
            near = group << 32 | near[occurs[near]]
            a = np.searchsorted(keys, near)
            found.append(items[ranges(a, np.searchsorted(keys, near, "right") - a)])
        return np.unique(np.concatenate(found))

    def candidates(self, print_: np.ndarray, group: int) -> np.ndarray:
        """Every item of a group within the radius."""
        met = self.met(print_, group)
        return met[np.bitwise_count(self.packed[met] ^ np.packbits(print_).view(np.uint64)).sum(axis=1) <= self.radius]

    def search(self, docs: list[np.ndarray], least: float = SIMILARITY) -> list[dict[int, tuple[float, int]]]:
        """For each document's hashed words, item's number: (best similarity, first word of the window)."""
        out: list[dict[int, tuple[float, int]]] = [{} for _ in docs]
        size_of = np.array([len(w) for w in docs], np.int64)
        first = np.cumsum(size_of) - size_of
        all_words = np.concatenate([np.empty(0, np.uint64), *docs])
        for k in np.unique(np.minimum(self.lengths, SHINGLE)).tolist():
            if len(all_words) < k:
                continue
            shingles = shingle_hashes(all_words, k)
            maybe = np.flatnonzero(self.filter[shingles >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
            same = self.known[place] == shingles[maybe]
            maybe, place = maybe[same], place[same]
            owner = np.searchsorted(first, maybe, "right") - 1
            whole = maybe + k <= first[owner] + size_of[owner]
            maybe, place, owner = maybe[whole], place[whole], owner[whole]
            edges = np.flatnonzero(np.diff(owner)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(owner)], strict=True):
                if b > a:
                    doc = int(owner[a])
                    low, n = int(first[doc]), int(size_of[doc]) - k + 1
                    self._windows(shingles[low : low + n], maybe[a:b] - low, place[a:b], k, least, out[doc])
        return out

    def _windows(self, s: np.ndarray, hits: np.ndarray, place: np.ndarray, k: int, least: float, best: dict[int, tuple[float, int]]) -> None:
        counts = self.at[place + 1] - self.at[place]
        spots, groups = np.repeat(hits, counts), self.pairs[1][ranges(self.at[place], counts)]
        order = np.argsort(groups, kind="stable")
        spots, groups = spots[order], groups[order]
        edges = np.flatnonzero(np.diff(groups)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(groups)], strict=True):
            g = int(groups[a])
            if min(int(self.lengths[g]), SHINGLE) != k:
                continue
            size = int(self.sizes[g])
            w = min(size, len(s))
            need = math.ceil(least * (w + size) / (1 + least) - 1e-9)
            if b - a < need:
                continue
            at = spots[a:b]
            # windows with enough hits begin within w before each run of as many hits
            runs = np.flatnonzero(at[need - 1 :] - at[: b - a - need + 1] < w)
            low, high = np.maximum(0, at[runs + need - 1] - w + 1), np.minimum(at[runs], len(s) - w)
            starts = np.unique(ranges(low, np.maximum(0, high - low + 1)))
            for part in range(0, len(starts), 4096):
                some = starts[part : part + 4096]
                for start, p in zip(some.tolist(), fingerprints(s, some, w), strict=True):
                    for i in self.candidates(p, g).tolist():
                        sim = similarity(s[start : start + w], self.flat[self.ends[i] : self.ends[i + 1]])
                        if sim >= least - 1e-12 and (i not in best or sim > best[i][0]):
                            best[i] = (sim, start)


def item_blocks(benchmark: DataFrame, limit: int = INDEX_BYTES, most: int = INDEX_ITEMS) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size, fetched one block at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator():
        text = r.text.encode()
        if block and (size + len(text) > limit or len(block) >= most):
            yield block
            block, size = [], 0
        block.append((r.item_id, text))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, limit: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, similarity and first_word of each item that a window of a document's whole text repeats.

    Words are runs of letters and digits in lower case; an item of under five words is one shingle. Null and empty
    texts and items, and items without id, match nothing. A document that is shorter than an item is one window. Repeated
    rows and items repeat no result, and rows that share an id, or have none, are one document: the best window of each
    pair is kept, the first of equals. Other columns, whatever their names, don't matter. An empty table, or an empty benchmark, gives no rows.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long"
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark, limit):
        carried = spark.sparkContext.broadcast(Index(items))  # at most ``limit`` bytes of text and INDEX_ITEMS items, or one item

        def run(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            index, hashed = carried.value, WordHash()
            for batch in chunks(batches, "text"):
                found = index.search([hashed.of(words(t)) for t in text_bytes(batch.column(1))], least)
                rows = [(doc, index.ids[i], sim, at) for doc, best in zip(batch.column(0).to_pylist(), found, strict=True) for i, (sim, at) in best.items()]
                if rows:
                    types = [batch.schema.field(0).type, item_type, pa.float64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "item_id", "similarity", "first_word"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("first_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, limit: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, each judged by its own text, with or without an id. Rows without text stay."""
    column = docs.columns.index("text")
    out = docs
    for items in item_blocks(benchmark, limit):
        carried = docs.sparkSession.sparkContext.broadcast(Index(items))

        def clean(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            index, hashed = carried.value, WordHash()
            for batch in chunks(batches, "text"):
                found = index.search([hashed.of(words(t)) for t in text_bytes(batch.column(column).cast(pa.string()))], least)
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of every document: nulls, empty and long texts, ties, repeats and empty tables as in ``find_leaks``."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
