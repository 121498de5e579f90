"""Toxicity scores by FTRL-proximal logistic regression over hashed features.

Features of a text, each counted once: its words (lower case, ASCII punctuation
dropped), pairs of neighbouring words, and pairs with one word between, hashed
into ``1 << bits`` coordinates. Training keeps a learning rate for each
coordinate and an L1 penalty leaves most weights exactly zero; what remains is
broadcast: 12 bytes a weight, at most one a coordinate, so under 26 MB.

Fitting uses a bounded sample: at most ``most_rows`` labelled documents outside
the held-out fold, those with the smallest seeded hash of their id, positives and
negatives alike, with their whole texts. Features are computed on all executors;
one task then takes them in a seeded order, epoch by epoch, as a stream, so only
one batch and the coordinates are in memory. Scoring is one narrow pass over all
documents and whole texts.

Defined results: a null or empty text has only the bias. Labels that are null
are left out; an id labelled twice counts with its largest label, and of an id
with several texts the largest text is learnt from; without labelled rows every
score is 0.5. A score of exactly the threshold is predicted (and rejected).
Repeated rows get equal scores. Columns of ``docs`` other than doc_id and text
are never read. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import fold, fold_of
from textloom.llm.words import word_hashes

BITS, MOST_ROWS, EPOCHS, SEED = 21, 12_000, 6, "toxic"
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.01
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Coordinates of the text's features; may repeat."""
    h = word_hashes(text or "")
    shift = np.uint64(64 - bits)
    near = h[:-1] * _ODD[1] + h[1:] * _ODD[2]
    skip = h[:-2] * _ODD[3] + h[2:] * _ODD[4]
    return (np.concatenate([h, near, skip]) * _ODD[0] >> shift).astype(np.int64)


def packed(at: np.ndarray) -> bytes:
    """Sorted coordinates as the gaps between them, in two bytes each where that is enough (first byte: 2 or 4)."""
    gaps = np.diff(at, prepend=0)
    size = 2 if gaps.max(initial=0) < 1 << 16 else 4
    return bytes([size]) + gaps.astype(f"<u{size}").tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, dtype=f"<u{x[0]}", offset=1), dtype=np.int64)


@dataclass
class Model:
    """Sparse weights; ``coordinates`` are sorted."""

    bias: float
    coordinates: np.ndarray
    weights: np.ndarray
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, dtype=np.float32)
        out[self.coordinates] = self.weights
        return out


class Ftrl:
    """FTRL-proximal state: z and n of each coordinate, and of the bias (without L1)."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = self.bias = 0.0

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        """One row: its coordinates, each once, and its label."""
        z, n = self.z[at], self.n[at]
        w = self.weights(z, n)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + self.bias, -35, 35))) - y
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * self.bias
        self.bias_n += g * g
        self.bias = -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha + self.l2)

    def model(self) -> Model:
        w = self.weights(self.z, self.n)
        kept = np.flatnonzero(w)
        return Model(float(self.bias), kept, w[kept].astype(np.float32), self.bits)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most_rows: int, seed: str) -> DataFrame:
    """doc_id, y and text of the bounded sample, one row a document id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label)).cast("int").alias("y"))
    # Labels of documents that are not here must not fill the bound.
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("_doc")), F.col("_id") == F.col("_doc"), "left_semi")
    chosen = known.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("_id").cast("string"))), "_id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["_id"])
    return found.groupBy("doc_id").agg(F.max("y").alias("y"), F.max(F.coalesce("text", F.lit(""))).alias("text"))


def learnt(sample: DataFrame, epochs: int, seed: str, learn: Callable[[Iterator[tuple[int, bytes, int]]], object]) -> object:
    """What ``learn`` makes, in one task, of the stream (epoch, x, y) of ``sample`` (doc_id, x, y).

    Each epoch has all rows, in a seeded order of its own. Spark sorts them, on
    disk where they are many, so the task holds a batch. ``learn`` returns
    something that can be pickled and whose size does not follow the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((e.as_py(), x.as_py(), y.as_py()) for b in batches for e, x, y in zip(b.column(0), b.column(1), b.column(2)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(rows))], pa.binary())], names=["made"])

    each = sample.select(F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"), "x", "y", "doc_id")
    order = F.md5(F.concat_ws("|", F.lit(seed), "epoch", "doc_id"))
    each = each.withColumn("order", order).repartition(1).sortWithinPartitions("epoch", "order", "doc_id").select("epoch", "x", "y")
    made = each.mapInArrow(run, "made binary").collect()  # one row, none without a sample
    return pickle.loads(made[0]["made"]) if made else learn(iter(()))


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, most_rows: int = MOST_ROWS, epochs: int = EPOCHS, seed: str = SEED, **options) -> Model:
    sample = training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, most_rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [packed(np.unique(features(t.as_py(), bits))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])

    def learn(rows: Iterator[tuple[int, bytes, int]]) -> Model:
        state = Ftrl(bits, **options)
        for _, x, y in rows:
            state.learn(unpacked(x), y)
        return state.model()

    return learnt(sample.mapInArrow(run, "doc_id long, y int, x binary"), epochs, seed, learn)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights = own.dense()
        for batch in batches:
            total = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                at = features(text.as_py(), own.bits)
                total[i] = weights[np.unique(at[weights[at] != 0])].sum(dtype=np.float64)
            scores = 1.0 / (1.0 + np.exp(-np.clip(total + own.bias, -35, 35)))
            out = [fold_of(i.as_py(), FOLDS) == HELD_OUT for i in batch.column(0)]
            columns = [batch.column(0), pa.array(out, pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    ready = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights, limit = own.dense(), np.log(threshold / (1 - threshold)) - own.bias
        for batch in batches:
            kept = []
            for text in batch.column("text"):
                at = features(text.as_py(), own.bits)
                kept.append(weights[np.unique(at[weights[at] != 0])].sum(dtype=np.float64) < limit)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
