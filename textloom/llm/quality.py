"""Quality scores by a byte-level convolutional network in numpy.

A filter adds one learned number for each of ``WIDTH`` successive bytes. Its
responses over the whole text are max-pooled in overlapping chunks of
``2 * HALF`` bytes, one every ``HALF``; the chunk maxima (rectified) are pooled
over the document by their maximum and by their mean, and a logistic unit makes
one probability of both. Gradients flow through the places of the maxima.

Fitting uses a bounded sample: at most ``most_rows`` labelled documents outside
the held-out fold, those with the smallest seeded hash of their id, with every
byte of their texts. One task takes them in a seeded order, epoch by epoch, as a
stream. Scoring reads every byte of every text in one narrow pass. Fitting and
scoring hold the responses of ``PIECE`` positions at a time.

Defined results: a null text is the empty text; texts shorter than a filter are
padded with zero bytes. Null labels are left out; an id labelled twice counts
with its largest label, and of an id with several texts the largest is learnt
from; without labelled rows every score is 0.5. A score of exactly the threshold
is predicted. Repeated rows get equal scores. Only doc_id and text of ``docs`` are
read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import fold_of
from textloom.llm.toxicity import learnt, training_rows

WIDTH, FILTERS, HALF, PIECE = 4, 16, 128, 1 << 18
MOST_ROWS, EPOCHS, BATCH, RATE, DECAY, SEED = 4000, 6, 32, 0.01, 1e-4, "quality"
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7


@dataclass
class Network:
    """taps: WIDTH x 256 x FILTERS; peak and mean weigh the two poolings."""

    taps: np.ndarray
    offset: np.ndarray
    peak: np.ndarray
    mean: np.ndarray
    bias: np.ndarray

    @classmethod
    def random(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        return cls(draw(WIDTH, 256, FILTERS), np.zeros(FILTERS, np.float32), draw(FILTERS), draw(FILTERS), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


def _bytes(text: str | bytes | None) -> np.ndarray:
    raw = text if isinstance(text, bytes) else (text or "").encode()
    return np.frombuffer(raw + bytes(max(0, WIDTH - len(raw))), dtype=np.uint8)


def _responses(taps: np.ndarray, raw: np.ndarray) -> np.ndarray:
    n = len(raw) - WIDTH + 1
    out = taps[0][raw[:n]]
    for j in range(1, WIDTH):
        out += taps[j][raw[j : j + n]]
    return out


def _halves(taps: np.ndarray, raw: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Filter maxima of each stretch of HALF positions, and where they are."""
    n, tops, at = len(raw) - WIDTH + 1, [], []
    for start in range(0, n, PIECE):
        response = _responses(taps, raw[start : min(n, start + PIECE) + WIDTH - 1])
        whole = len(response) // HALF * HALF
        parts = [response[:whole].reshape(-1, HALF, FILTERS)] * (whole > 0) + [response[None, whole:]] * (whole < len(response))
        tops += [p.max(axis=1) for p in parts]
        if places:
            firsts = [start + HALF * np.arange(len(p)) + offset for p, offset in zip(parts, (0, whole) if whole else (0,))]
            at += [p.argmax(axis=1) + f[:, None] for p, f in zip(parts, firsts)]
    return np.concatenate(tops), np.concatenate(at) if places else None


def probability(net: Network, text: str | None) -> float:
    halves, _ = _halves(net.taps, _bytes(text))
    chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    chunks = np.maximum(chunks + net.offset, 0)
    z = chunks.max(axis=0) @ net.peak + chunks.mean(axis=0) @ net.mean + net.bias[0]
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _gradient(net: Network, raw: np.ndarray, y: float, grads: list[np.ndarray]) -> None:
    """Adds the gradient of the log loss of one text."""
    top, place = _halves(net.taps, raw, places=True)
    if len(top) > 1:
        later = top[1:] > top[:-1]
        place, top = np.where(later, place[1:], place[:-1]), np.maximum(top[:-1], top[1:])
    chunks = np.maximum(top + net.offset, 0)
    best, peak, mean = chunks.argmax(axis=0), chunks.max(axis=0), chunks.mean(axis=0)
    z = peak @ net.peak + mean @ net.mean + net.bias[0]
    g = np.float32(1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
    taps, offset, peak_g, mean_g, bias = grads
    peak_g += g * peak
    mean_g += g * mean
    bias += g
    back = np.full_like(chunks, 0) + g * net.mean / len(chunks)
    back[best, np.arange(FILTERS)] += g * net.peak
    back *= chunks > 0
    offset += back.sum(axis=0)
    chunk, which = np.nonzero(back)
    at, value = place[chunk, which], back[chunk, which]
    for j in range(WIDTH):
        np.add.at(taps[j], (raw[at + j], which), value)


class Adam:
    """Trains a network on rows as they come, a batch a step; an epoch's last batch may be smaller."""

    def __init__(self, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = 7):
        self.net, self.epochs, self.rate, self.decay, self.step = Network.random(seed), epochs, rate, decay, 0
        self.first, self.second, self.grads = ([np.zeros_like(p) for p in self.net.parameters()] for _ in range(3))
        self.waiting, self.epoch = 0, 1

    def learn(self, epoch: int, raw: np.ndarray, y: int) -> None:
        if epoch != self.epoch:
            self.flush()
            self.epoch = epoch
        _gradient(self.net, raw, float(y), self.grads)
        self.waiting += 1
        if self.waiting == BATCH:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        self.step += 1
        pace = self.rate * (1 - (self.epoch - 1) / self.epochs)
        for p, g, m, v in zip(self.net.parameters(), self.grads, self.first, self.second):
            g /= self.waiting
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= pace * (m / (1 - 0.9**self.step) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8) + self.decay * p)
            g[...] = 0
        self.waiting = 0


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, epochs: int = EPOCHS, seed: str = SEED, **options) -> Network:
    sample = training_rows(docs, labels, "quality", FOLDS, HELD_OUT, most_rows, seed)

    def learn(rows: Iterator[tuple[int, bytes, int]]) -> Network:
        state, seen = Adam(epochs, **options), 0
        for epoch, x, y in rows:
            state.learn(epoch, _bytes(x), y)
            seen += 1
        state.flush()
        if not seen:
            state.net.peak[:] = state.net.mean[:] = 0
        return state.net

    return learnt(sample.select("doc_id", F.col("text").cast("binary").alias("x"), "y"), epochs, seed, learn)


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([probability(shared.value, text.as_py()) for text in batch.column(1)])
            out = [fold_of(i.as_py(), FOLDS) == HELD_OUT for i in batch.column(0)]
            columns = [batch.column(0), pa.array(out, pa.bool_()), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    ready = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options))
