"""Toxicity (operator 9): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct cells of its words, word pairs and pairs with one word between, once with
the words themselves (lower-cased, ASCII punctuation as white space) and once with words cut to their first
STEM letters, so that inflected forms share evidence. Cells seen in fewer than MIN_DOCS training documents are
left out. Training follows the FTRL-proximal rule: per-coordinate learning rates from
accumulated squared gradients, L1 for sparsity, L2 for stability; documents come in hash order, PASSES
times. The learnt weights are sparse, so what is broadcast is a short list of cells.

Training documents: labelled, and ``crc32(doc_id as text) % 3 <> 1``; of these a hashed share whose
expected number is below ``max_train``, without texts above TRAIN_BYTES (documented bounds of what the driver
holds, the only sample here). Every text is scored whole. Inputs of a score are
the words of the whole text, nothing else.

Defined cases: a null or empty text has no features and scores the bias; without labelled documents the
score is 1/2 for all; labels that disagree for one doc_id count as examples each; a null doc_id counts as
not held out; repeated rows are scored each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8
from .langid import hashed_sample, held_out

BITS = 20
MAX_TRAIN = 16_000
TRAIN_BYTES = 1 << 16
PASSES = 4
MIN_DOCS = 5
STEM = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
CUTOFF = 0.7
FOLDS, FOLD = 3, 1
_PLAIN = bytes(32 if (c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128) and chr(c) not in "'" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def stem(word: bytes) -> bytes:
    return word.decode("utf-8", "replace")[:STEM].encode() if len(word) > STEM else word


def cells(words: list[bytes]) -> np.ndarray:
    """Cells of words, bigrams and skip-bigrams, whole and cut, with repeats."""
    if not words:
        return np.zeros(0, np.int64)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    found = []
    pair = lambda a, b, m: (a * _M2 ^ b * m) * _M1
    with np.errstate(over="ignore"):
        for form in (seen, map(stem, seen)):
            h = np.fromiter(map(zlib.crc32, form), np.uint64, len(seen))[ids] + np.uint64(1)
            found += [h * _M1, pair(h[:-1], h[1:], _M1), pair(h[:-2], h[2:], _M3)]
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes) -> np.ndarray:
    """All distinct cells of a text."""
    return np.unique(cells(words_of(text)))


class Ftrl:
    """Per-coordinate state z, n; weights are read off lazily, the bias is the last coordinate and unpenalised."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.bias = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, features: np.ndarray, label: float) -> float:
        at = np.append(features, self.bias)
        w = self.weights(at)
        p = _sigmoid(float(w.sum()))
        g = p - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        return p

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange(self.bias + 1))
        at = np.flatnonzero(w[:-1])
        return at, w[at], float(w[-1])


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> pa.Table:
    """label and distinct cells of the bounded sample, in hash order."""
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(FOLDS, FOLD)).select("doc_id", F.col("toxic").cast("double").alias("label"))
    some = hashed_sample(marked, max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t).astype(np.int32) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "label", "cells"])

    short = docs.select("doc_id", "text").filter(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) <= TRAIN_BYTES)
    joined = short.join(F.broadcast(some), "doc_id").select(F.col("doc_id").cast("long"), "label", F.col("text").cast("string"))
    return joined.mapInArrow(run, "doc_id long, label double, cells array<int>").withColumn("h", F.xxhash64("doc_id", F.lit(3))).toArrow()


def fit(found: list[np.ndarray], marks: list[float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights (cells, values, bias) from documents' cells and labels, in the order given."""
    often = np.zeros(1 << BITS, np.int32)
    for f in found:
        often[f] += 1
    kept = [f[often[f] >= MIN_DOCS] for f in found]
    model = Ftrl()
    for _ in range(PASSES):
        for f, y in zip(kept, marks, strict=True):
            model.learn(f, y)
    return model.sparse()


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    rows = training_rows(docs, labels, max_train)
    order = np.lexsort((rows["label"].to_numpy(), rows["doc_id"].to_numpy(), rows["h"].to_numpy())).tolist()
    found, marks = rows["cells"].combine_chunks() if len(rows) else [], rows["label"].to_pylist()
    return fit([found[i].values.to_numpy() for i in order], [marks[i] for i in order])  # views, no copies


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        used = dense != 0
        for b in batches:
            out = []
            for text in utf8(b.column(2)):
                c = cells(words_of(text))
                out.append(_sigmoid(float(dense[np.unique(c[used[c]])].sum()) + bias))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64()), pa.array([int(p >= CUTOFF) for p in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(FOLDS, FOLD).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
