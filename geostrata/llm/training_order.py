"""Token-ID output in training order.

Each document's token ids are cut into sequences of a fixed length. Sequences are
numbered in one order that depends on the documents alone (hash of id and text), a keyed
Feistel permutation with cycle-walking gives each number its global slot, and one
exchange brings ranges of slots together as shards: fixed-stride binary files whose
row r starts at byte r * stride, so that a reader can go on from any slot. Beside each
file lies one of index entries, of a fixed stride too.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import CHUNK_BYTES, chunks, drop_table, give_back, mix, put_table, shared_uri, size_in_bytes, table
from geostrata.llm.token_counts import default_path, encoder

#: Tokens of a sequence, sequences of a shard, id that fills up a document's last sequence.
LENGTH, SHARD, PAD_ID = 512, 4096, 50256
KEY, FEISTEL_ROUNDS = 0x5EED, 6
#: Bytes of input to a bucket of documents, and fewest and most buckets.
BUCKET_BYTES, BUCKETS = 8 << 20, (16, 1 << 20)
#: Buckets, and shards, to a task, which handles them one by one, and fewest tasks.
IN_TASK, TASKS = 4, 4
#: Rounds in which shards are dealt out and written: a share of the sequences is in exchange at a time.
ROUNDS = 4
#: Bytes of rows that go to Python at once: with its last row, a batch is seldom more than a chunk.
BATCH_BYTES = CHUNK_BYTES * 7 // 8
#: Bytes of an index entry: doc_id, number in the document, real tokens.
ENTRY = 24
_NONE = np.iinfo(np.int64).min


def feistel(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = FEISTEL_ROUNDS) -> np.ndarray:
    """Slots of numbers below n: a keyed bijection on 0 .. n - 1, walking on from values that are n or more."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(rounds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return left << half | right

    out = once(numbers.astype(np.uint64))
    while (over := np.flatnonzero(out >= np.uint64(n))).size:
        out[over] = once(out[over])
    return out.astype(np.int64)


def _pack(ids: np.ndarray, *parts: np.ndarray | bytes) -> bytes:
    import zstandard

    body = b"".join(p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts)
    return zstandard.ZstdCompressor(level=3).compress(len(ids).to_bytes(8, "little") + ids.astype("<i8").tobytes() + body)


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, "<i8", n, 8), raw[8 + 8 * n :]


def _tokenise(path: str, buckets: int):
    """Rows of (bucket, blob): ids of documents, their keys, lengths, token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what other steps left in this worker
        enc = encoder(path)
        for batch in chunks(batches, "text"):
            got: dict[int, list[tuple[int, int, np.ndarray]]] = {}
            ids = [_NONE if i is None else i for i in batch.column(0).to_pylist()]
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            places = (mix(keys.view(np.uint64)) >> np.uint64(32)).astype(np.float64) * (buckets / 2**32)
            for i, key, b, text in zip(ids, keys.tolist(), places.astype(np.int64).tolist(), batch.column(2).to_pylist(), strict=True):
                if text:
                    got.setdefault(b, []).append((i, key, enc.encode(text)))
            if got:
                blobs = [_pack(*(np.array(c, np.int64) for c in ([x[0] for x in v], [x[1] for x in v], [len(x[2]) for x in v])), *(x[2].astype("<u2") for x in v)) for v in got.values()]
                yield pa.record_batch([pa.array(list(got), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
                del blobs
            del got
            give_back()

    return run


def _no_encoder() -> None:
    """Steps after the tokens make no ids: workers drop the encoder that they keep from task to task, and what it took."""
    encoder.cache_clear()
    give_back()


def _sequence(length: int, pad: int):
    """Of one bucket, in order of the documents' keys: its sequences in blocks, with the bucket's number of the first of each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _no_encoder()
        docs = []
        for blob in rows["blob"]:
            ids, body = _unpack(blob)
            keys, sizes = np.frombuffer(body, "<i8", 2 * len(ids)).reshape(2, -1)
            tokens = np.frombuffer(body, "<u2", offset=16 * len(ids))
            at = np.cumsum(sizes) - sizes
            docs += [(h, i, zlib.crc32(t := tokens[a : a + s].tobytes()), t) for h, i, a, s in zip(mix(keys.view(np.uint64)).tolist(), ids.tolist(), at.tolist(), sizes.tolist(), strict=True)]
        docs.sort(key=lambda d: d[:3])
        fill, out, first = np.array([pad], "<u2").tobytes(), [], 0
        ids: list[int] = []
        parts: list[bytes] = []
        entries: list[tuple[int, int]] = []

        def flush() -> None:
            nonlocal first
            if ids:
                out.append((int(rows["bucket"].iloc[0]), first, len(ids), _pack(np.array(ids, np.int64), np.array(entries, np.int64), *parts)))
                first += len(ids)
                ids.clear(), parts.clear(), entries.clear()

        for _, i, _, t in docs:
            n = len(t) // 2
            count = -(-n // length)
            ids += [i] * count
            entries += [(k, min(length, n - k * length)) for k in range(count)]
            parts.append(t + fill * (count * length - n))
            if len(ids) >= 2048:
                flush()
        flush()
        return pd.DataFrame(out, columns=["bucket", "first", "n", "blob"]).astype({"bucket": "int32", "first": "int64", "n": "int64"})

    return run


def _open(uri: str):
    """File system and path of a URI, for any store that pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(store, name: str, data: bytes) -> None:
    """Write a file whole and then put it in place, so that a task that is run again does no harm."""
    part = f"{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, name)


def materialise(docs: DataFrame, uri: str | None = None, tokenizer: str | None = None, length: int = LENGTH, shard: int = SHARD, key: int = KEY, pad: int = PAD_ID) -> DataFrame:
    """Writes shards below ``uri`` (or in the shared folder) and returns their list: shard, file, index, first_slot, n and stride.

    A file holds n rows of stride bytes, 16-bit ids; its index n entries of doc_id, number in the document and real tokens,
    ENTRY bytes each. Documents without tokens (null or empty texts) have no sequence. Rows without id are kept under the
    smallest number. Repeated rows are sequences of their own. The same documents, key and lengths give the same shards
    however they are partitioned. Other columns, whatever their names, don't matter. An empty table gives no shard.
    """
    spark = docs.sparkSession
    path = tokenizer or default_path()
    root = (uri or shared_uri(spark, "order-files")).rstrip("/")
    buckets = min(BUCKETS[1], max(BUCKETS[0], size_in_bytes(docs) // BUCKET_BYTES))
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    texts = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("text"))
    tokens = texts.mapInArrow(_tokenise(path, buckets), "bucket int, blob binary").repartition(max(TASKS, buckets // IN_TASK), "bucket")
    blocks = put_table(tokens.groupBy("bucket").applyInPandas(_sequence(length, pad), "bucket int, first long, n long, blob binary"), "order-blocks", "none", BATCH_BYTES)
    counts = {r.bucket: r.n for r in blocks.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # a row for each bucket, 2 ** 20 at most
    sizes = np.array([counts.get(b, 0) for b in range(buckets)], np.int64)
    total = int(sizes.sum())
    before = spark.sparkContext.broadcast(np.cumsum(sizes) - sizes)  # 8 MB at most
    stride = 2 * length

    def deal(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _no_encoder()
            for bucket, first, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, body = _unpack(blob)
                entries = np.frombuffer(body, "<i8", 2 * n).reshape(n, 2)
                data = np.frombuffer(body, np.uint8, offset=16 * n).reshape(n, stride)
                slots = feistel(before.value[bucket] + first + np.arange(n), total, key)
                order = np.argsort(slots, kind="stable")
                to = slots[order] // shard
                edges = np.flatnonzero(np.diff(to)) + 1
                rows = [order[a:b] for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True) if to[a] % ROUNDS == turn]
                if not rows:
                    continue
                blobs = [_pack(slots[r], ids[r], entries[r], data[r]) for r in rows]
                yield pa.record_batch([pa.array([int(slots[r[0]] // shard) for r in rows], pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        _no_encoder()
        slots, index, data = [], [], []
        for blob in rows["blob"]:
            s, body = _unpack(blob)
            n = len(s)
            ids, entries = np.frombuffer(body, "<i8", n), np.frombuffer(body, "<i8", 2 * n, 8 * n).reshape(n, 2)
            slots.append(s)
            index.append(np.concatenate([ids[:, None], entries], axis=1))
            data.append(np.frombuffer(body, np.uint8, offset=24 * n).reshape(n, stride))
        s = np.concatenate(slots)
        order = np.argsort(s, kind="stable")
        s = s[order]
        if not np.array_equal(s, np.arange(s[0], s[0] + len(s))):
            raise ValueError("slots of a shard have gaps")
        number = int(s[0]) // shard
        store, folder = _open(root)
        store.create_dir(folder)
        name = f"shard-{number:08d}"
        _put(store, f"{folder}/{name}.bin", np.concatenate(data)[order].tobytes())
        _put(store, f"{folder}/{name}.idx", np.concatenate(index)[order].astype("<i8").tobytes())
        return pd.DataFrame({"shard": [number], "file": [f"{root}/{name}.bin"], "index": [f"{root}/{name}.idx"], "first_slot": [int(s[0])], "n": [len(s)], "stride": [stride]})

    tasks = max(TASKS, -(-total // shard) // IN_TASK // ROUNDS)
    parts = []
    for turn in range(ROUNDS):
        dealt = blocks.select("bucket", "first", "n", "blob").mapInArrow(partial(deal, turn=turn), "shard long, blob binary").repartition(tasks, "shard")
        parts.append(put_table(dealt.groupBy("shard").applyInPandas(write, "shard long, file string, index string, first_slot long, n long, stride int"), f"order-shards{turn}", batch=BATCH_BYTES))
    out = reduce(DataFrame.unionByName, parts)
    drop_table(blocks)
    return out


def sequences(shards: DataFrame, first_slot: int = 0) -> DataFrame:
    """slot, shard, row, doc_id, seq_no, n_tokens and crc32 of each stored sequence from ``first_slot`` on, as read from the files; nothing before it is read."""

    def rest_of(uri: str, start: int, size: int) -> bytes:
        store, path = _open(uri)
        with store.open_input_file(path) as f:
            f.seek(start)
            return f.read(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, index, first, n, stride in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                skip = max(0, first_slot - first)
                data = rest_of(file, skip * stride, (n - skip) * stride)
                e = np.frombuffer(rest_of(index, skip * ENTRY, (n - skip) * ENTRY), "<i8").reshape(n - skip, 3)
                if len(data) != (n - skip) * stride:
                    raise ValueError(f"{file} is cut short")
                crc = [zlib.crc32(data[r * stride : (r + 1) * stride]) for r in range(n - skip)]
                rows = np.arange(skip, n)
                yield pa.record_batch(
                    [pa.array(first + rows), pa.array(np.full(n - skip, shard)), pa.array(rows.astype(np.int32)), pa.array(e[:, 0], mask=e[:, 0] == _NONE), pa.array(e[:, 1].astype(np.int32)), pa.array(e[:, 2].astype(np.int32)), pa.array(crc, pa.int64())],
                    names=["slot", "shard", "row", "doc_id", "seq_no", "n_tokens", "crc32"],
                )

    wanted = shards.where(F.col("first_slot") + F.col("n") > first_slot).select("shard", "file", "index", "first_slot", "n", "stride")
    tasks = max(TASKS, wanted.count() // IN_TASK)
    return wanted.repartition(tasks, "shard").mapInArrow(run, "slot long, shard long, row int, doc_id long, seq_no int, n_tokens int, crc32 long")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of all documents as read back from the shards' files: nulls, empty and long texts, repeats and empty tables as in ``materialise``."""
    return sequences(materialise(table(spark, sf_dir, "documents")))
