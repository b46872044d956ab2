"""State of iterations: tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or where that is unset and all runs on one machine (tests) a temporary folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="geostrata-")
        sc.setCheckpointDir(root)
    return root


def settle(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder, read again: its lineage ends, and its size is that of its files.

    A checkpoint would keep the size that was estimated for its plan; in a loop that joins a state with itself the
    estimate squares in each round, up to numbers that the planner can't handle. Tables of ``done``, states that nothing
    reads any longer, are deleted; all others go at exit.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/geostrata-state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _KEPT:
        atexit.register(release)
    _KEPT.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    for old in done:
        release(old._settled_at)
    return out


def release(path: str | None = None) -> None:
    """Delete the table at ``path``, or all."""
    for kept in [k for k in _KEPT if path in (None, k[1])]:
        _KEPT.remove(kept)
        try:
            p = kept[0].sparkContext._jvm.org.apache.hadoop.fs.Path(kept[1])
            p.getFileSystem(kept[0].sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            pass
