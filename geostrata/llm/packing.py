"""Packing documents into sequences in their order, by dynamic programming over window cuts.

Documents stand one after another, in order of id. A sequence is a window of that stream;
windows are cut where a document or a sentence ends, and inside a sentence only where it is
very long. A set of cuts costs the padding of its windows and a penalty for every cut that
truncates a document. With g(j) the cost of the best cuts up to candidate j plus its
position, g(j) = penalty(j) + length + min g(i) over the candidates i that a window reaches
back to: a sliding minimum, which a monotone queue gives in constant time a candidate.

Token ids go through one exchange, by ranges of (id, hash of text). A range is read as a
stream and solved in stretches, so that no task holds more than a stretch or its longest
document; only the last window of a range is cut short by the range's end.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import chunks, put_table, ranges, size_in_bytes, table
from geostrata.llm.token_counts import default_path, encoder

#: Tokens of a sequence, and the id that ends every document.
LENGTH, END_ID = 2048, 1
#: What a cut costs, in tokens of padding: at a document's end, at a sentence's end, and inside a sentence.
AT_DOCUMENT, AT_SENTENCE, INSIDE = 0, 2, 8
#: A sentence may be cut inside after every so many tokens.
STEP = 32
#: Tokens of a stretch, and windows at its end that are decided again with the next stretch.
STRETCH, AGAIN = 1 << 20, 8
#: Bytes of stored token ids to a range.
RANGE_BYTES = 8 << 20
#: What ends a sentence, and what may follow it before the white space. Fixed values.
MARKS, CLOSING = (".", "!", "?", "…", "。", "！", "？", "؟", "।"), "\"'”’»)]}"


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """Places of the cheapest cuts, the last place among them.

    places: candidates in rising order, none more than ``length`` after the one before (the stream's start, 0, is one and
    isn't listed). The cost is the padding of all windows and the penalties of all cuts; of equal costs the longer window is kept.
    """
    at, cost = places.tolist(), (penalties + length).tolist()
    before = [0] * len(at)
    window: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # (place, g, candidate), g rising
    for j, here in enumerate(at):
        while here - window[0][0] > length:
            window.popleft()
        _, least, before[j] = window[0]
        g = cost[j] + least
        while window and window[-1][1] > g:
            window.pop()
        window.append((here, g, j))
    out, j = [], len(at) - 1
    while j >= 0:
        out.append(at[j])
        j = before[j]
    return out[::-1]


@lru_cache(maxsize=4)
def sentence_marks(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token id: whether it may end a sentence, whether it begins with white space, whether it ends a line."""
    enc = encoder(path)
    of = {c: b for b, c in enc.letters.items()}
    ends, blank, line = (np.zeros(max(enc.vocab.values()) + 1, bool) for _ in range(3))
    for letters, i in enc.vocab.items():
        word = letters if letters in enc.specials else bytes(of[c] for c in letters).decode("utf-8", "ignore")
        ends[i] = word.rstrip(CLOSING).endswith(MARKS)
        blank[i] = word[:1].isspace()
        line[i] = word.endswith("\n")
    return ends, blank, line


def candidates(ids: np.ndarray, stops: np.ndarray, marks: tuple[np.ndarray, np.ndarray, np.ndarray], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) where the stream ``ids`` may be cut; documents end at ``stops``."""
    ends, blank, line = marks
    after, following = ids[:-1], ids[1:]
    inner = np.flatnonzero((ends[after] & blank[following]) | (line[after] & ~blank[following])) + 1
    places = np.union1d(inner, stops)
    penalties = np.where(np.isin(places, stops, assume_unique=True), AT_DOCUMENT, AT_SENTENCE)
    gaps = np.diff(places, prepend=0)
    more = (gaps - 1) // step
    if more.any():
        starts = places - gaps
        extra = np.repeat(starts, more) + step * ranges(np.ones(len(more), np.int64), more)
        places, penalties = np.concatenate([places, extra]), np.concatenate([penalties, np.full(len(extra), INSIDE)])
        order = np.argsort(places, kind="stable")
        places, penalties = places[order], penalties[order]
    return places, penalties


class Packer:
    """Takes documents one by one and gives rows of pieces, in order; holds a stretch."""

    def __init__(self, marks: tuple[np.ndarray, np.ndarray, np.ndarray], length: int, first_id: int):
        self.marks, self.length, self.next_id = marks, length, first_id
        self.docs: list[tuple[object, np.ndarray, int]] = []  # doc_id, ids that are left, ids before them
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids)

    def solve(self, last: bool) -> tuple[list, ...] | None:
        """Pieces of all windows that are settled: doc_id, start, length, doc_tokens, sequence_id, offset and ids (32-bit little-endian)."""
        if not self.docs:
            return None
        ids = np.concatenate([d[1] for d in self.docs])
        stops = np.cumsum([len(d[1]) for d in self.docs])
        cuts = np.array(best_cuts(*candidates(ids, stops, self.marks, min(STEP, self.length)), self.length))
        if not last:
            cuts = cuts[: max(1, len(cuts) - AGAIN)]
        end = int(cuts[-1])
        edges = np.union1d(cuts, stops[stops < end])
        starts = np.concatenate([[0], edges[:-1]])
        doc, sequence = np.searchsorted(stops, starts, "right"), np.searchsorted(cuts, starts, "right")
        begun = stops - np.array([len(d[1]) for d in self.docs])
        before = np.array([d[2] for d in self.docs])
        wide = ids[:end].astype("<u4")
        out = (
            [self.docs[d][0] for d in doc.tolist()],
            (starts - begun[doc] + before[doc]).tolist(),
            (edges - starts).tolist(),
            (stops - begun + before)[doc].tolist(),
            (self.next_id + sequence).tolist(),
            (starts - np.concatenate([[0], cuts])[sequence]).tolist(),
            [wide[a:b].tobytes() for a, b in zip(starts.tolist(), edges.tolist(), strict=True)],
        )
        self.next_id += len(cuts)
        open_ = int(np.searchsorted(stops, end, "right"))
        rest = self.docs[open_:]
        if rest and end > begun[open_]:
            doc_id, part, n = rest[0]
            rest[0] = (doc_id, part[end - int(begun[open_]) :], n + end - int(begun[open_]))
        self.docs, self.held = rest, len(ids) - end
        return out


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids (binary, unsigned 32-bit little-endian).

    Each document's ids and ``end_id`` lie in exactly one piece each; a sequence's pieces stand in it without gaps, in
    order of doc_id (nulls first), rows of one id by a hash of their texts. Null and empty texts are the end id alone.
    Repeated rows are packed each for itself; which of them stands first makes no difference. A text longer than a
    sequence goes over several. Other columns, whatever their names, don't matter. An empty table gives no pieces.
    """
    path = tokenizer or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u2").tobytes()
        for batch in chunks(batches, "text"):
            ids = [(enc.encode(t).tobytes() if t else b"") + end for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["doc_id", "key", "ids"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(sentence_marks(path), length, TaskContext.get().partitionId() << 40)

        def rows(got: tuple[list, ...] | None) -> Iterator[pa.RecordBatch]:
            if got:
                types = [key_type, *[pa.int64()] * 5, pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(got, types, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.frombuffer(ids.as_buffer(), "<u2"))
                if packer.held >= STRETCH:
                    yield from rows(packer.solve(False))
        yield from rows(packer.solve(True))

    named = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    tokens = put_table(named.mapInArrow(tokenise, f"doc_id {kind}, key long, ids binary"), "pack-tokens")
    n = max(1, -(-size_in_bytes(tokens) // RANGE_BYTES))
    order = ["doc_id", "key", "row"]  # row: splits rows that are equal otherwise
    dealt = tokens.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(lay, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids (binary, 32-bit, padded to ``length``) of what ``pack`` returns: a sequence's pieces follow each other in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = np.array([pad], "<u4").tobytes()
        now, parts = None, []

        def row() -> pa.RecordBatch:
            ids = b"".join(parts)
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([len(ids) // 4], pa.int32()), pa.array([ids + fill * (length - len(ids) // 4)], pa.binary())], names=["sequence_id", "n_tokens", "ids"])

        for batch in batches:
            for sequence, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sequence != now and parts:
                    yield row()
                    parts = []
                now = sequence
                parts.append(ids)
        if parts:
            yield row()

    return pieces.select("sequence_id", "ids").mapInArrow(run, "sequence_id long, n_tokens int, ids binary")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of all documents: nulls, empty and long texts, ties, repeats and empty tables as in ``pack``."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
