"""Toxicity scores by logistic regression with FTRL-proximal learning over hashed word features.

Features are present or absent: words, pairs of neighbours, and pairs with one word skipped, hashed to a fixed
space. Learning keeps a rate per coordinate, and its L1 term leaves most weights zero, so what is broadcast to
score all documents is a short list.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, texts, unit

BITS = 20
#: Labelled rows that the model is fitted on, about, at most: a documented bound, for learning alone.
SAMPLE = 20_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0
THRESHOLD = 0.7
HELD = 500_000
SEED = 7
#: What parts words besides ASCII white space.
_PARTS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


class Features:
    """Sorted distinct feature numbers of texts; 0 is the constant feature of every text."""

    def __init__(self, bits: int = BITS) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.hashes: dict[bytes, int] = {}

    def hash(self, word: bytes) -> int:
        if len(self.hashes) >= HELD:
            self.hashes.clear()
        h = self.hashes[word] = zlib.crc32(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS).split()
        get, new = self.hashes.get, self.hash
        h = np.array([get(w) or new(w) for w in words], np.uint64)
        parts = [h * np.uint64(0x9E3779B97F4A7C15)]
        for gap, seed in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            if len(h) > gap:
                parts.append((h[:-gap] * np.uint64(0xD6E8FEB86659FD93) + h[gap:]) * np.uint64(seed))
        f = np.concatenate(parts)
        f = ((f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(24) & self.mask
        f = np.sort(f.astype(np.int32))
        f = f[np.concatenate([[True], f[1:] != f[:-1]])] if len(f) else f
        return np.concatenate([[0], f[f != 0]]).astype(np.int32)


class Ftrl:
    """FTRL-proximal with binary features."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, f: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[f], self.n[f]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / step)

    def learn(self, f: np.ndarray, label: int) -> None:
        w = self.weights(f)
        g = sigmoid(w.sum()) - label
        n = self.n[f]
        grown = n + g * g
        self.z[f] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[f] = grown


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def held_out(doc_id: Column) -> Column:
    """Documents of whose labels nothing is learned: crc32 of the doc_id as text leaves 1 when divided by 3. A null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_weights(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, text), (doc_id, toxic) -> the features with a weight, and the weights.

    Rows whose toxic is not 0 or 1 are left out, repeated labels of a document count by the greatest. Beyond
    `sample` labelled rows a share of them, chosen by a hash of doc_id, is learned from. Rows are learned in the
    order of that hash in one task, whose size the sample bounds. No labels: no weights.
    """
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", unit(F.col("doc_id").cast("long"), SEED).alias("u"))
    n = marks.count()
    if n > sample:
        marks = marks.where(F.col("u") < sample / n)
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")  # about `sample` rows at most

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        made = Features()
        for b in batches:
            f = [made.of(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), b.column("u"), b.column("toxic"), pa.array(f, pa.binary())], names=["doc_id", "u", "toxic", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(), []
        for b in batches:
            seen += [(np.frombuffer(f.as_py(), np.int32), y.as_py()) for f, y in zip(b.column("f"), b.column("toxic"), strict=True)]
        for _ in range(epochs):
            for f, y in seen:
                model.learn(f, y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(w[at])], names=["feature", "weight"])

    made = rows.mapInArrow(featurize, "doc_id long, u double, toxic int, f binary")
    found = made.repartition(1).sortWithinPartitions("u", "doc_id").mapInArrow(train, "feature int, weight double").collect()
    return np.array([r.feature for r in found], np.int32), np.array([r.weight for r in found])


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, text) -> (doc_id, score), one row per input row, from the text alone; a null text is empty."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        made, w = Features(), np.zeros(1 << BITS)
        w[sent.value[0]] = sent.value[1]
        for b in batches:
            x = np.array([w[made.of(t.as_py())].sum() for t in b.column("text")], float)
            yield pa.record_batch([b.column("doc_id"), pa.array(sigmoid(x))], names=["doc_id", "score"])

    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
