"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the presence of lower-cased words, word pairs, and pairs around
one word, hashed into ``DIMS`` coordinates. Each coordinate has its own learning
rate and an L1 penalty, so most weights stay exactly 0 and the
broadcast model is the list of the others.

The model is fitted on a bounded sample of labelled rows (at most ``SAMPLE`` rows and ``MOST_IDS``
features, smallest seeded hash) in the order of that hash; every row is scored over its whole text.

Edge cases: a null text counts as empty and scores by the bias alone. Without
labelled rows each score is 0.5 less the bias of none: 0.5. A row with several
labels is toxic if one of them is. Repeated rows are scored one by one. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import clean_text, fold
from gneiss.llm.text_features import TOKENS, Hashes, ngram_ids

DIMS = 1 << 20
SAMPLE = 12_000
#: Features of the sample in all: what the driver holds.
MOST_IDS = 32_000_000
FOLDS, HELD_OUT = 5, 0
SEED = 2
THRESHOLD = 0.5
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.1, 10


def features(text: str, hashes: Hashes) -> np.ndarray:
    h = hashes.of(TOKENS.findall(text.lower()))
    return ngram_ids(h, DIMS, skip=True) if len(h) else np.zeros(0, np.int32)


class Ftrl:
    """Weights follow from sums z and n; the last coordinate is the bias, free of the L1 penalty."""

    def __init__(self, dims: int = DIMS):
        self.z, self.n = np.zeros(dims + 1), np.zeros(dims + 1)
        self.dims = dims

    def weights(self, ids: np.ndarray) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        free = ids == self.dims
        l1 = np.where(free, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, ids: np.ndarray, label: int) -> None:
        ids = np.append(ids, self.dims)
        w = self.weights(ids)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[ids] += g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Coordinates with a weight, their weights, and the bias."""
        w = self.weights(np.arange(self.dims + 1))
        ids = np.flatnonzero(w[:-1])
        return ids.astype(np.int32), w[ids].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, seed: int = SEED, most: int = MOST_IDS) -> Ftrl:
    """A model of a bounded sample of labelled rows for which ``learn`` holds."""
    known = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    texts = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min(clean_text()).alias("text"))

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            found = [features(t, hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "ids"])

    rows = texts.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "doc_id long, toxic int, ids binary")
    data, held = [], 0
    for r in rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").toLocalIterator():
        ids = np.frombuffer(r["ids"], np.int32)
        if held <= most:
            data.append((ids, r["toxic"]))
            held += len(ids)
    model = Ftrl()
    for _ in range(EPOCHS):
        for ids, label in data:
            model.learn(ids, label)
    return model


def score(docs: DataFrame, model: Ftrl, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model.compact())

    def run(batches):
        at, values, bias = shared.value
        w, hashes = np.zeros(DIMS, np.float32), Hashes()
        w[at] = values
        for batch in batches:
            found = [1 / (1 + np.exp(-np.clip(float(w[features(t, hashes)].sum()) + bias, -30, 30))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), clean_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, fit(docs, labels, fold("doc_id", FOLDS) != HELD_OUT), threshold)
