"""From raw documents to training shards: five of the operators in ``geostrata.llm``, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``, whatever others there are. What a stage kept in the shared folder goes when the next one begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geostrata.llm.common import put_table, release_tables, table, tagged
from geostrata.llm.decontaminate import decontaminate
from geostrata.llm.jaccard_join import first_of_each
from geostrata.llm.mixing import take
from geostrata.llm.quality import passing, train
from geostrata.llm.training_order import materialise, sequences

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_tables("stage")
        with tagged("stage"):
            return f(spark, docs, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of these documents, gives 0.5 or more."""
    return passing(docs, train(docs, table(spark, sf_dir, "labels")))


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of the Jaccard join; of repeated rows one. Empty texts all stay."""
    return first_of_each(docs)


@_stage
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item, with or without an id."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return take(docs)


@_stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids in training order, as read back from the stored shards."""
    return sequences(materialise(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_leaks),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", shards),
]

#: Trained weights, balanced sampling and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: stored sequences, as ``shards`` gives them; no rows if no document is left.

    Rows with null, shared or repeated ids, with empty or very long texts and with further columns are judged each by its
    own text, as the stages state; ties are decided as there.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = put_table(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
