"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.llm import textvec

BITS = 18
#: At most so many labelled rows train the model: those with the least hash of their key.
TRAIN_ROWS = 20_000

_KIND = np.full(256, 3, np.uint8)  # other
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[48:58] = 1
_KIND[65:91] = _KIND[97:123] = 2
_KIND[128:] = 2


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Each text's distinct feature numbers: single tokens and pairs, hashed. Tokens are runs of letters, digits or other signs; case counts."""
    rows, n = len(offsets) - 1, len(data)
    if not n:
        return [np.zeros(0, np.int64)] * rows
    kind = _KIND[data]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    inner = offsets[1:-1]
    start[inner[inner < n]] = True
    at = np.flatnonzero(start)
    end = np.concatenate((at[1:], [n]))
    solid = kind[at] != 0
    at, end = at[solid], end[solid]
    token = textvec.hash_spans(data, at, end)
    pair = textvec.combine(token[:-1], token[1:]) if len(token) else token
    row = np.searchsorted(offsets, at, side="right") - 1
    bounds = np.searchsorted(row, np.arange(rows + 1))
    shift = np.uint64(64 - bits)
    one, two = (token >> shift).astype(np.int64), (pair >> shift).astype(np.int64)
    return [np.unique(np.concatenate((one[a:b], two[a : max(a, b - 1)]))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Ftrl:
    """Follow-the-regularised-leader (proximal) logistic regression with a state of fixed size; feature 0 of the tail is the bias."""

    def __init__(self, bits: int, alpha: float = 2.0, beta: float = 0.03, l1: float = 0.002, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        lean = z - np.sign(z) * self.l1
        return np.where(np.abs(z) <= self.l1, 0.0, -lean / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def _inputs(found: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: features share a length of one, the bias has one of its own."""
    return np.concatenate((found, [1 << bits])), np.concatenate((np.full(len(found), 1 / np.sqrt(max(len(found), 1))), [1.0]))


def _extract(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.text_buffer(batch.column(batch.num_columns - 1))
            for a, b in textvec.chunks(offsets):
                at = offsets[a : b + 1]
                found = features(data[at[0] : at[-1]], at - at[0], bits)
                kept = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "features"])

    return run


def _train(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = Ftrl(bits), []
        for batch in batches:
            for label, f, copies in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                rows += [(label.as_py(), np.asarray(f.values.to_numpy(), np.int32))] * copies.as_py()
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                label, found = rows[k]
                model.learn(*_inputs(found, bits), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(np.arange((1 << bits) + 1)).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, bits: int, rows: int) -> DataFrame:
    """(turn, label, features, copies): at most ``rows`` of the pairs of a document and a label with one key, by the least hash of the key.

    The pairs are chosen after the join, from keys and hashes of texts, so labels without a document
    take no place and repeated keys do not add to the rows. The choice is small and is broadcast to
    the texts: no text is shuffled. A text keeps all its features; pairs that are alike are one row
    with its number of copies.
    """
    texts = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("label"))
    pairs = texts.select("_key", "_hash").join(marked, F.col("_key") == F.col("_k")).select(F.xxhash64("_key").alias("turn"), F.col("_key").alias("_k"), "label", F.col("_hash").alias("_h"))
    chosen = pairs.orderBy("turn", "_k", "label", "_h").limit(rows).groupBy("turn", "_k", "label", "_h").agg(F.count(F.lit(1)).alias("copies"))
    sample = texts.join(F.broadcast(chosen), (F.col("_key") == F.col("_k")) & (F.col("_hash") == F.col("_h"))).select("turn", "label", "_hash", "copies", "_text")
    found = sample.mapInArrow(_extract(bits), "turn long, label int, _hash long, copies long, features array<int>")
    once = found.groupBy("turn", "label", "_hash").agg(F.first("features").alias("features"), F.first("copies").alias("copies"))
    return once.select("turn", "label", "features", "copies")


def train_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", bits: int = BITS, rows: int = TRAIN_ROWS, epochs: int = 4) -> np.ndarray:
    """Weights of the classifier (2 ** bits and a bias) from at most ``rows`` labelled documents.

    Labelled rows are joined by key; null keys and null labels are left out, repeated labels train
    as often as they are there. Without labelled rows all weights are 0. The sample is a fixed
    function of the rows (see ``training_rows``), and each of its texts trains on all its features.
    """
    found = training_rows(docs, labels, key=key, text=text, label=label, bits=bits, rows=rows)
    fitted = found.repartition(1).sortWithinPartitions("turn", "label", "features").mapInArrow(_train(bits, epochs), "weights binary").first()
    return np.frombuffer(fitted["weights"], "<f4") if fitted else np.zeros((1 << bits) + 1, np.float32)


def _score(weights, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights.value, "<f4").astype(np.float64)
        for batch in batches:
            data, offsets = textvec.text_buffer(batch.column(batch.num_columns - 1))
            margin = np.empty(batch.num_rows)
            for a, b in textvec.chunks(offsets):
                at = offsets[a : b + 1]
                for k, f in enumerate(features(data[at[0] : at[-1]], at - at[0], bits), a):
                    margin[k] = w[-1] + (w[f].sum() / np.sqrt(len(f)) if len(f) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], names=[*batch.schema.names[:-1], "score"])

    return run


def score_quality(docs: DataFrame, weights: np.ndarray, *, text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with a column score in 0 to 1 (replaced where there is one): the sparse dot product of each whole text.

    Null and empty texts have the bias alone. The weights have a fixed size and are broadcast.
    """
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(weights.astype("<f4").tobytes())
    kept = [c for c in docs.columns if c != "score"]
    rows = docs.select(*kept, F.col(text).alias("__scored_text__"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) if kept else ""
    return rows.mapInArrow(_score(sent, bits), f"{schema}{', ' if schema else ''}score double")


def held_out(key: str, folds: int = 4, fold: int = 2):
    """Whether a row's key falls in the fold that labels are never learned from (null keys do not)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold`` on), trained on the labels outside the held-out fold."""
    weights = train_quality(docs, labels.where(~held_out(key)), key=key, text=text)
    return score_quality(docs, weights, text=text).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
