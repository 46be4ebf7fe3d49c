"""Quality scores from random-indexing word vectors and a two-layer network.

Every word, hashed into VOCABULARY rows, has a sparse index vector: two signs at two of DIMENSIONS
places, from its hash. A word's vector is the sum of the index vectors of its neighbours, one to
either side, over the whole corpus: whole numbers, so that reruns agree. A document is pooled as
the mean and spread of its words' unit vectors and the logarithm of its number of words. A network
with one hidden layer is trained on a bounded sample of labelled rows, and a temperature, fitted
on a part of the sample that it was not trained on, calibrates its probabilities.

Defined cases: null and empty texts pool to zeros and are scored so; with no labelled row the
score is 0.5 for all; null labels are not learned from; repeated rows agree; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _text
from graphloom.llm._shared import cut
from graphloom.llm.language_id import held_out

VOCABULARY, DIMENSIONS = 1 << 14, 24
HIDDEN, EPOCHS = 32, 40
#: The bounded sample that is learned from: labelled rows with the smallest hashes.
TRAIN_ROWS = 12_000
THRESHOLD = 0.7


def _row(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (VOCABULARY - 1)


def _index(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places and signs of the words' index vectors."""
    out = []
    for shift in (36, 48):
        x = (hashes >> np.uint64(shift)).astype(np.int64)
        out.append((x % DIMENSIONS, 1 - 2 * ((x >> 11) & 1)))
    return out


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(VOCABULARY * DIMENSIONS, np.int64)
    for batch in batches:
        for _, _, data, off in _text.blocks(batch.column("text")):
            w = _text.words(data, off)
            if len(w.hashes) < 2:
                continue
            owner = np.repeat(np.arange(len(off) - 1), np.diff(w.first))
            near = np.flatnonzero(owner[1:] == owner[:-1])
            row = _row(w.hashes) * DIMENSIONS
            for place, sign in _index(w.hashes):
                for me, other in ((near, near + 1), (near + 1, near)):
                    sums += np.bincount(row[me] + place[other], sign[other], len(sums)).astype(np.int64)
    sums = sums.reshape(VOCABULARY, DIMENSIONS)
    at = np.flatnonzero(sums.any(1))
    for i in range(0, len(at), 4096):
        part = at[i : i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(sums[part, k].copy()) for k in range(DIMENSIONS)]], names=["row", *[f"v{k}" for k in range(DIMENSIONS)]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(VOCABULARY, DIMENSIONS) unit vectors from all of docs; that many numbers come to the driver."""
    cols = [f"v{k}" for k in range(DIMENSIONS)]
    got = docs.select("text").mapInArrow(_accumulate, "row long, " + ", ".join(f"{c} long" for c in cols)).groupBy("row").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    out = np.zeros((VOCABULARY, DIMENSIONS))
    out[got["row"]] = got[cols].to_numpy(np.float64)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.maximum(norm, 1e-9)).astype(np.float32)


N_FEATURES = 2 * DIMENSIONS + 2


def features(vectors: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, N_FEATURES): mean and spread of the word vectors, the mean's length, log(1 + words)."""
    n = len(off) - 1
    w = _text.words(data, off)
    owner = np.repeat(np.arange(n), np.diff(w.first))
    v = vectors[_row(w.hashes)]
    count = np.maximum(np.diff(w.first), 1)[:, None]
    mean = np.stack([np.bincount(owner, v[:, k], n) for k in range(DIMENSIONS)], 1) / count
    square = np.stack([np.bincount(owner, v[:, k] * v[:, k], n) for k in range(DIMENSIONS)], 1) / count
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, spread, np.sqrt((mean * mean).sum(1, keepdims=True)), np.log1p(np.diff(w.first))[:, None]], 1).astype(np.float32)


def _pool(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in _text.blocks(batch.column("text")):
                x = features(vectors, data, off)
                cells = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), cells], names=["doc_id", "x"])

    return run


class Classifier(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11, hidden: int = HIDDEN, epochs: int = EPOCHS, rate: float = 0.004) -> Classifier:
    """Adam on four fifths of the rows; the temperature is the one of a grid with the least cross entropy on the rest."""
    k = x.shape[1]
    if not len(x):
        return Classifier(np.zeros(k), np.ones(k), np.zeros((k, 1)), np.zeros(1), np.zeros(1), np.zeros(1), 1.0)
    r = np.random.default_rng(seed)
    x, mean, scale = x.astype(np.float64), x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-6
    z, rest = (x - mean) / scale, np.arange(len(x)) % 5 == 0
    p = [r.standard_normal((k, hidden)) * (2 / k) ** 0.5, np.zeros(hidden), r.standard_normal(hidden) * hidden**-0.5, np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    at = np.flatnonzero(~rest) if len(x) > 5 else np.arange(len(x))
    for epoch in range(epochs):
        r.shuffle(at)
        for i in range(0, len(at), 256):
            b = at[i : i + 256]
            h = z[b] @ p[0] + p[1]
            a = np.maximum(h, 0)
            d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -50, 50))) - y[b]) / len(b)
            back = np.outer(d, p[2]) * (h > 0)
            step += 1
            for j, g in enumerate((z[b].T @ back + 1e-4 * p[0], back.sum(0), a.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                m[j] += 0.1 * (g - m[j])
                v[j] += 0.001 * (g * g - v[j])
                p[j] -= rate * (1 - epoch / epochs) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    c = Classifier(mean, scale, *p, 1.0)
    s, t = c.logits(x[rest]), y[rest]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.logaddexp(0, np.where(t == 1, -s, s) / g).mean() for g in grid]
    return c._replace(temperature=float(grid[int(np.argmin(loss))]))


def _matrix(column: pa.Array) -> np.ndarray:
    off, data = _text.buffers(column)
    return data[off[0] : off[-1]].view(np.float32).reshape(-1, N_FEATURES) if len(off) > 1 else np.zeros((0, N_FEATURES), np.float32)


def _apply(model: Classifier, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.round(model.score(_matrix(batch.column("x"))), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, predicted of every row of docs (doc_id, text); labels (doc_id, quality) are all learned from, up to train_rows."""
    pooled = cut(docs.select("doc_id", "text").mapInArrow(_pool(word_vectors(docs)), "doc_id long, x binary"))
    chosen = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows)
    rows = pooled.join(F.broadcast(chosen), "doc_id").select("doc_id", "x", "y").toPandas().sort_values(["doc_id", "y"])
    x = np.frombuffer(b"".join(map(bytes, rows["x"])), np.float32).reshape(-1, N_FEATURES)
    return pooled.mapInArrow(_apply(train(x, rows["y"].to_numpy()), threshold), "doc_id long, score double, predicted int")


def op8_quality(spark, sf_dir) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_quality(docs.select("doc_id", "text"), labels.filter(~held_out(labels, 4, 2)))
    return found.select("doc_id", held_out(found, 4, 2).alias("held_out"), "score", "predicted")
