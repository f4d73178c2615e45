"""Toxicity: a character n-gram linear classifier with naive Bayes scaling.

Features are the distinct character 3-, 4- and 5-grams of a lower-cased text,
hashed into a fixed table.  Each is scaled by its naive Bayes log-count ratio
and a logistic regression is fitted on the scaled features, so evidence that
the labels support starts large and the rest near zero.

The fit reads a bounded sample (``MAX_TRAINING`` labelled rows, lowest digest
of doc_id first), whose n-grams are found on the executors and reach the driver as
at most 32 KB a document; every text is scored whole, in chunks.  Labels enter only
through that sample, and doc_id only to choose it.

A null text is empty and gets the score of the bias; labels that are null are
ignored, repeated labels of a document count once (the larger); without any
usable label, or with one class only, the score is the smoothed share of label
1; repeated rows get equal scores; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (3, 4, 5)
BITS = 18
MAX_TRAINING = 10_000
MIN_DOCUMENTS = 4
EPOCHS = 8
RATE = 0.05
DECAY = 1e-4
CHUNK = 1 << 18
SEED = 7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        z = self.bias + float(self.weights[features].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def features(text: str | None, table: np.ndarray) -> np.ndarray:
    """Ids of the n-grams that occur in the whole text.  ``table``: 2^BITS zero bytes, left zero."""
    if not text:
        return np.empty(0, np.int64)
    widest = ORDERS[-1] - 1
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), CHUNK):
        some = points[at : at + CHUNK + widest].astype(np.uint64)
        for n in ORDERS:
            if len(some) < n:
                continue
            h = some[: len(some) - n + 1].copy()
            for k in range(1, n):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                h += some[k : len(some) - n + 1 + k]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            table[(h >> np.uint64(64 - BITS)).view(np.int64)] = 1
    found = np.flatnonzero(table)
    table[found] = 0
    return found


def fit(texts: list[str | None], labels: list[int]) -> Model:
    table = np.zeros(1 << BITS, np.uint8)
    return fit_features([features(t, table).astype(np.int32) for t in texts], labels)


def fit_features(rows: list[np.ndarray], labels: list[int]) -> Model:
    """Naive Bayes ratios, then logistic regression on the scaled features by AdaGrad over fixed random batches.

    Only columns that enough documents have are kept, so a step costs what these do.
    """
    y = np.array(labels, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    size = 1 << BITS
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size, np.float32), bias)
    counts = np.zeros((2, size))  # the n-grams of each label's documents
    for r, label in zip(rows, labels):
        counts[label, r] += 1
    keep = counts.sum(axis=0) >= min(MIN_DOCUMENTS, len(y) / 4)
    p, q = (1 + counts[1]) / (2 + y.sum()), (1 + counts[0]) / (2 + len(y) - y.sum())
    kept, column = np.flatnonzero(keep), (np.cumsum(keep) - 1).astype(np.int32)
    ratio = np.log(p / q)[kept]
    for k, r in enumerate(rows):
        rows[k] = column[r[keep[r]]]
    weight, squares, bias_squares = np.zeros(len(kept)), np.full(len(kept), 1e-8), 1e-8
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 32):
            batch = order[at : at + 32]
            ids = np.concatenate([rows[i] for i in batch])
            lengths = [len(rows[i]) for i in batch]
            owner = np.repeat(np.arange(len(batch)), lengths)
            z = bias + np.bincount(owner, (weight * ratio)[ids], len(batch))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            gradient = np.bincount(ids, error[owner], len(kept)) * ratio + DECAY * weight
            squares += gradient**2
            weight -= RATE * gradient / np.sqrt(squares)
            g = error.sum()
            bias_squares += g * g
            bias -= RATE * g / np.sqrt(bias_squares)
    whole = np.zeros(size, np.float32)
    whole[kept] = weight * ratio
    return Model(whole, float(bias))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the doc_id as text is divisible by ``folds`` (a null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = MAX_TRAINING) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64(F.col("id")), "id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(known), "id").withColumn("order", F.xxhash64("id", "text"))
    found = chosen.select("order", "id", "label", "text").mapInArrow(_packed, "order long, id long, label int, found binary")
    sample = found.orderBy(F.xxhash64("id"), "id", "order").limit(rows).collect()
    labels_of = [r["label"] for r in sample]
    found_of = [r["found"] for r in sample]
    del sample
    return fit_features([_unpacked(found_of.pop()) for _ in range(len(found_of))][::-1], labels_of)


def _bytes(found: np.ndarray, table: np.ndarray) -> bytes:
    """Feature ids as gaps or as a bit table, whichever is shorter: at most 2^BITS / 8 bytes and a mark."""
    gaps = np.diff(found, prepend=0)
    kind = "<u2" if gaps.max(initial=0) < 1 << 16 else "<u4"
    if len(found) * int(kind[-1]) <= len(table) // 8:
        return kind[-1].encode() + gaps.astype(kind).tobytes()
    table[found] = 1
    bits = np.packbits(table).tobytes()
    table[found] = 0
    return b"b" + bits


def _packed(batches):
    """Feature ids of each whole text."""
    table = np.zeros(1 << BITS, np.uint8)
    for b in batches:
        out = [_bytes(features(t.as_py(), table), table) for t in b.column(3)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], ["order", "id", "label", "found"])


def _unpacked(found: bytes) -> np.ndarray:
    if found[:1] == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(found, np.uint8, offset=1))).astype(np.int32)
    return np.cumsum(np.frombuffer(found, f"<u{found[:1].decode()}", offset=1), dtype=np.int32)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = np.zeros(1 << BITS, np.uint8)
        for b in batches:
            scores = [shared.value.score(features(t.as_py(), table)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double")
