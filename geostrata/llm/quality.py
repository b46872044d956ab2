"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader updates, scored as sparse dot products."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import WordHash, chunks, mix, table, text_bytes

#: Weights are 2 ** BITS single-precision numbers: 1 MB, whatever the corpus.
BITS = 18
#: Most labelled rows that a model is fitted on; they are those with the smallest hash of doc_id.
MAX_TRAIN = 6000
EPOCHS = 3
#: Learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1.0

#: Words of letters and digits, and runs of ASCII punctuation: both are words here.
WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[!-/:-@\[-`{-~]+").findall


def features(text: bytes, hashed: WordHash) -> np.ndarray:
    """Places of the text's word unigrams and bigrams, repeats included. A word twice in a row is one and the same bigram whatever the word."""
    w = hashed.of(WORDS(text))
    if not len(w):
        return np.empty(0, np.int64)
    pairs = mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])
    pairs[w[:-1] == w[1:]] = np.uint64(0x5851F42D4C957F2D)
    return (np.concatenate([w, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. A feature's value is its count over the root of the number of features, so that texts of any length count alike."""
    z, n, bias_z, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    sparse = []
    for places, label in rows:
        at, count = np.unique(places, return_counts=True)
        sparse.append((at, count / math.sqrt(max(1, len(places))), label))
    for _ in range(epochs):
        for at, x, label in sparse:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            b = -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x) + b))))
            g = (p - label) * x
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g2
            g0 = p - label
            bias_z += g0 - (math.sqrt(bias_n + g0 * g0) - math.sqrt(bias_n)) / ALPHA * b
            bias_n += g0 * g0
    return weights(z, n).astype(np.float32), -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """A model from at most ``max_train`` labelled rows outside the held-out fold.

    Labels of ids that documents lack and null labels are ignored; of repeated labels the smallest counts, of the texts
    that share an id the first in order.
    Without any usable label every score is 0.5.
    """
    seen = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out())
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(~held_out())
    picked = known.groupBy("doc_id").agg(F.min("label").alias("label")).join(seen, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # at most max_train ids
    rows = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # however many rows share an id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, got = WordHash(), []
        for batch in batches:
            for text, label in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                got.append((features(text, hashed), label))
        weights, bias = fit(got)
        yield pa.record_batch([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    # one task fits: its rows are at most max_train
    model = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label").mapInArrow(run, "weights binary, bias double").collect()
    return (np.frombuffer(model[0].weights, np.float32), model[0].bias) if model else (np.zeros(1 << BITS, np.float32), 0.0)


def _scores(texts: pa.Array, model: tuple[np.ndarray, float], hashed: WordHash) -> list[float]:
    weights, bias = model
    out = []
    for text in text_bytes(texts):
        places = features(text, hashed)
        dot = float(weights[places].sum(dtype=np.float64)) / math.sqrt(max(1, len(places))) + bias
        out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, dot)))))
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of each row's whole text.

    A null text scores as an empty one: by the bias alone. A null id stays null. Repeated rows score alike. Other columns,
    whatever their names, don't matter. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for batch in chunks(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), pa.array(_scores(batch.column("text"), model, hashed), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def passing(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``least`` or more; each by its own text, as in ``score``."""
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for batch in chunks(batches, "text"):
            yield batch.filter(pa.array([s >= least for s in _scores(batch.column(column), model, hashed)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents: nulls, empty and long texts, ties of labels, repeats and empty tables as in ``train`` and ``score``. A score of exactly 0.5 is predicted 1."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
