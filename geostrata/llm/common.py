"""Shared parts of the training-data operators: shared-folder tables, Arrow helpers and word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z and nothing else, as bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER, and every ASCII byte that is no letter or digit becomes a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Rows handled at once in a Python worker hold about this much text.
CHUNK_BYTES = 4 << 20

#: Tables in the shared folder, with the tag that held when they were made.
_KEPT: list[tuple[SparkSession, str, str]] = []
_TAG = [""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset and all runs on one machine (tests) a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="geostrata-")
        sc.setCheckpointDir(root)
    return root


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, by a full URI; it goes with the tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/geostrata-{name}-{uuid.uuid4().hex}")
    uri = str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())
    _keep(spark, uri)
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _keep(spark: SparkSession, path: str) -> None:
    if not _KEPT:
        atexit.register(release_tables)
    _KEPT.append((spark, path, _TAG[-1]))


#: Spark's own setting by which shuffle files of a query go when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own setting of the bytes after which a batch of rows goes to Python, beside its number of rows.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def put_table(df: DataFrame, name: str, compression: str = "zstd", batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors. What the query shuffled goes with its end.

    batch: bytes of rows that go to Python at once, if not as many as the session has set; a longer row goes alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/geostrata-{name}-{uuid.uuid4().hex}"
    own = {_CLEANUP: "true"} | ({_BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _keep(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


@contextmanager
def tagged(tag: str) -> Iterator[None]:
    """Tables made within can be released by ``tag``."""
    _TAG.append(tag)
    try:
        yield
    finally:
        _TAG.pop()


def release_tables(tag: str | None = None) -> None:
    """Delete tables of ``put_table`` whose readers are done: those of ``tag``, or all."""
    for kept in [k for k in _KEPT if tag is None or k[2] == tag]:
        _delete(kept)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``put_table`` returned, once all that was made of it is written elsewhere."""
    for kept in [k for k in _KEPT if k[1] == df._kept_at]:
        _delete(kept)


def _delete(kept: tuple[SparkSession, str, str]) -> None:
    _KEPT.remove(kept)
    try:
        p = kept[0].sparkContext._jvm.org.apache.hadoop.fs.Path(kept[1])
        p.getFileSystem(kept[0].sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; one longer value makes a batch alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.nbytes <= limit:
            yield batch
            continue
        sizes = np.frombuffer(pc.binary_length(batch.column(column).fill_null("")).cast(pa.int64()).buffers()[1], np.int64)[: batch.num_rows]
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def give_back() -> None:
    """Return what a Python worker has freed to the system: Spark keeps idle workers, each with all that its largest task once took."""
    pa.default_memory_pool().release_unused()
    if hasattr(c := ctypes.CDLL(None), "malloc_trim"):  # of glibc only
        c.malloc_trim(0)


class WordHash(dict):
    """64-bit hash of a word's bytes, remembered for up to ``most`` words."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of every run of ``size`` words; of the whole sequence if it is shorter; none of no words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(size, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h *= _M1
        h += words[i : n - k + 1 + i]
        h ^= h >> np.uint64(29)
    return mix(h + np.uint64(k))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i] + counts[i] - 1, for all i in one array."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - counts), counts)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Equally long 64-bit arrays as one compressed string, byte by byte of each: near numbers share their high bytes."""
    import zstandard

    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def expand(blob: bytes, k: int, dtype: type = np.uint64) -> list[np.ndarray]:
    """The k arrays of ``squeeze``."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8)
    n = len(raw) // (8 * k)
    return [np.ascontiguousarray(raw[i * 8 * n : (i + 1) * 8 * n].reshape(8, n).T).view(dtype).ravel() for i in range(k)]


def size_in_bytes(df: DataFrame) -> int:
    """Spark's estimate of the bytes that ``df`` scans: for numbers of groups only, never for what is computed."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.count() << 12  # Spark knows no size of what isn't a table
