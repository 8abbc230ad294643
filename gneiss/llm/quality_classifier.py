"""Quality classifier: positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled as good, the unlabelled set is web text of
any kind. With the class prior p, the risk of a linear scorer is

    p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

with the logistic loss; where the second term falls below 0, the step goes up it
instead. No row labelled as bad is used. The prior is estimated by the
best bin: the smallest ratio of the shares of unlabelled and positive rows above a score, less a margin for chance,
of scores by a model that has seen neither.

The trusted positives are bounded: at most ``SAMPLE`` labelled rows and ``MOST_IDS`` features, by the smallest seeded hash.
The unlabelled risk covers every row. A first model comes from a pilot of ``PILOT`` unlabelled
rows; one pass over all unlabelled rows then sums the risk and its gradient at that model, and the
counts of scores that give the prior. The risk that is minimised at last has the
pilot's curvature and the value and gradient of all rows: the pilot's risk, plus the difference of the two
gradients times the way from the first model (the surrogate likelihood of
communication-efficient distributed inference). What reaches the driver has a fixed size. Every row is scored over its whole
text.

Edge cases: a null text counts as empty; an empty text has its own style bins and
a score between 0 and 1. Without positives or unlabelled rows every score is the
prior of 0.5. Repeated rows count and are scored one by one; a doc_id counts once among the positives. A row with several labels is
trusted if one of them is good. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import bounded_ids, clean_text, fold
from gneiss.llm.text_features import LOW, STYLES, TOKENS, Words, ngram_ids, style_bins

DIMS = 1 << 16
SAMPLE = 5_000
#: Unlabelled rows that give the first model and the curvature.
PILOT = 5_000
#: Features of the positives, and of the pilot, in all.
MOST_IDS = 8_000_000
#: Bins of scores between -``REACH`` and ``REACH``, and parts in which sums are gathered.
BINS, REACH, PARTS = 4096, 30.0, 16
FOLDS, HELD_OUT = 5, 0
SEED = 1
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, RIDGE = 40, 250, 0.1, 3e-4


def features(text: str, known: Words) -> np.ndarray:
    """Indices of n-grams, which are present with unit length together, then of the style bins."""
    codes = known.of(TOKENS.findall(text))
    ids = ngram_ids(codes & LOW, DIMS, skip=False) if len(codes) else np.zeros(0, np.int32)
    return np.concatenate([ids, np.asarray(style_bins(text, codes), np.int32) + DIMS])


def values_of(ids: np.ndarray) -> np.ndarray:
    """The values of a row's features."""
    n = int(np.searchsorted(ids, DIMS))
    out = np.ones(len(ids), np.float32)
    out[:n] = 1 / np.sqrt(max(n, 1))
    return out


class Rows:
    """Sparse rows laid end to end."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = np.asarray([len(i) for i in rows], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.values = np.concatenate([values_of(i) for i in rows]) if rows else np.zeros(0, np.float32)

    def __len__(self) -> int:
        return len(self.n)

    def pick(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.n[which]
        row = np.repeat(np.arange(len(which)), n)
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[which], n)
        return row, self.ids[flat], self.values[flat]

    def margins(self, w: np.ndarray, b: float, which: np.ndarray) -> tuple[np.ndarray, tuple]:
        part = self.pick(which)
        return np.bincount(part[0], part[2] * w[part[1]], len(which)) + b, part


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def unlabelled_sums(rows: Rows, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
    """Sum over rows of the loss as negatives, and of its gradient, the bias last."""
    loss, gradient = 0.0, np.zeros(DIMS + STYLES + 1)
    for i in range(0, len(rows), 1000):
        z, (row, ids, values) = rows.margins(w, b, np.arange(i, min(i + 1000, len(rows))))
        g = sigmoid(z)
        loss += np.logaddexp(0, z).sum()
        gradient[:-1] += np.bincount(ids, values * g[row], DIMS + STYLES)
        gradient[-1] += g.sum()
    return float(loss), gradient


def train(pos: Rows, unl: Rows, prior: float, seed: int = SEED, shift: tuple[np.ndarray, np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (Adam steps).

    With ``shift`` (point, gradient, value), bias last, the unlabelled risk is that of ``unl`` plus value + gradient * (weights - point).
    """
    rng = np.random.default_rng(seed)
    size = DIMS + STYLES
    point, slope, value = shift or (np.zeros(size + 1), np.zeros(size + 1), 0.0)
    w, b, m, v = np.zeros(size), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    step = 0
    rounds = max(len(pos), len(unl)) // BATCH + 1
    for _ in range(EPOCHS):
        for _ in range(rounds):
            p = rng.integers(0, len(pos), min(BATCH, len(pos)))
            u = rng.integers(0, len(unl), min(BATCH, len(unl)))
            zp, part_p = pos.margins(w, b, p)
            zu, part_u = unl.margins(w, b, u)
            # logistic loss: softplus(-z) for a positive, softplus(z) for a negative
            moved = value + slope[:-1] @ (w - point[:-1]) + slope[-1] * (b - point[-1])
            negative = np.logaddexp(0, zu).mean() + moved - prior * np.logaddexp(0, zp).mean()
            gp_plus, gp_minus, gu = -sigmoid(-zp) / len(p), sigmoid(zp) / len(p), sigmoid(zu) / len(u)
            up = 1.0 if negative >= 0 else -1.0
            gp, gu = (prior * gp_plus - prior * gp_minus if up > 0 else prior * gp_minus), up * gu
            g = np.bincount(part_p[1], part_p[2] * gp[part_p[0]], size) + np.bincount(part_u[1], part_u[2] * gu[part_u[0]], size) + up * slope[:-1] + RIDGE * w
            g = np.append(g, gp.sum() + gu.sum() + up * slope[-1])
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return w, b


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores of held-back rows."""
    cuts = np.unique(pos)
    return prior_of(pos, cuts, 1 - np.searchsorted(np.sort(unl), cuts, "left") / len(unl), len(unl))


def prior_of(pos: np.ndarray, cuts: np.ndarray, above_u: np.ndarray, n: int) -> float:
    """The prior from scores of positives and the shares of ``n`` unlabelled rows above some cuts.

    It is the lower end for chance of the best bin's ratio: too high a prior leaves nothing
    for the rarer class, while the risk bears one that is a little low.
    """
    above_p = 1 - np.searchsorted(np.sort(pos), cuts, "left") / len(pos)
    margin = np.sqrt(np.log(20) / 2 / len(pos)) + np.sqrt(np.log(20) / 2 / n)
    bounds = (above_u + margin) / np.maximum(above_p, 1e-9)
    best = int(np.argmin(np.where(above_p > 0.05, bounds, np.inf)))
    return float(np.clip((above_u[best] - margin) / above_p[best], 0.05, 0.97))


def bin_of(z: np.ndarray) -> np.ndarray:
    return np.clip((z + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64)


def whole_sums(docs: DataFrame, w: np.ndarray, b: float) -> np.ndarray:
    """Over all rows: counts of scores by bin, then the sum of the gradient with the bias, then the sum of the loss.

    Tasks send their sums in parts; parts of some tasks are added up, then those of all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))
    size = BINS + DIMS + STYLES + 2

    def run(batches):
        from pyspark import TaskContext

        w, known, out = shared.value, Words(), np.zeros(size)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = Rows([features(t or "", known) for t in batch.column("text").slice(i, 1000).to_pylist()])
                z, _ = rows.margins(w, b, np.arange(len(rows)))
                loss, gradient = unlabelled_sums(rows, w, b)
                out[:BINS] += np.bincount(bin_of(z), minlength=BINS)
                out[BINS:-1] += gradient
                out[-1] += loss
        parts = np.array_split(out, PARTS)
        group = TaskContext.get().partitionId() // 256
        yield pa.RecordBatch.from_arrays([pa.array([group] * PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["group", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in table.column("sums").to_pylist()], axis=0)
        return pa.table({"group": pa.array([0], pa.int32()), "part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "group int, part int, sums binary"
    found = docs.select("text").mapInArrow(run, kind).groupBy("group", "part").applyInArrow(add, kind).groupBy("part").applyInArrow(add, kind)
    parts = {r["part"]: np.frombuffer(r["sums"]) for r in found.collect()}  # ``PARTS`` rows
    return np.concatenate([parts[k] for k in range(PARTS)]) if parts else np.zeros(size)


def extract(docs: DataFrame) -> DataFrame:
    """kind, doc_id and features of rows with a text."""

    def run(batches):
        known = Words()
        for batch in batches:
            found = [features(t, known).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("doc_id"), pa.array(found, pa.binary())], names=["kind", "doc_id", "ids"])

    return docs.select("kind", "doc_id", clean_text().alias("text")).mapInArrow(run, "kind int, doc_id long, ids binary")


def bounded_rows(docs: DataFrame, chosen: DataFrame, seed: int, most: int = MOST_IDS) -> dict[int, list[np.ndarray]]:
    """Features of the chosen rows (kind, doc_id) by kind, in the order of a seeded hash, as far as ``most`` features of a kind go."""
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("kind", "doc_id").agg(F.min("text").alias("text"))
    out: dict[int, list] = {0: [], 1: []}
    held = {0: 0, 1: 0}
    for r in extract(texts).orderBy("kind", F.xxhash64(F.lit(seed), "doc_id"), "doc_id").toLocalIterator():
        ids = np.frombuffer(r["ids"], np.int32)
        if held[r["kind"]] <= most:
            out[r["kind"]].append(ids)
            held[r["kind"]] += len(ids)
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, pilot: int = PILOT, seed: int = SEED) -> tuple[np.ndarray, float, float]:
    """Weights, bias and estimated prior from rows for which ``learn`` holds."""
    docs = docs.select("doc_id", "text")
    good = bounded_ids(labels.where(learn), F.col("quality") == 1, "doc_id", sample, seed).withColumn("kind", F.lit(1))
    raw = docs.where(learn).select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").limit(pilot).distinct().withColumn("kind", F.lit(0))
    rows = bounded_rows(docs, good.unionByName(raw), seed)
    if not rows[0] or not rows[1]:
        return np.zeros(DIMS + STYLES), 0.0, 0.5
    first = Rows(rows[0])
    learned, held = Rows(rows[1][1::2] or rows[1]), Rows(rows[1][::2])
    w, b = train(learned, first, 0.5, seed)
    # all unlabelled rows: what they add to the pilot, and the scores of those that the first model has not seen
    w = w.astype(np.float32).astype(np.float64)
    sums = whole_sums(docs.where(learn), w, b)
    scores, gradient, loss = sums[:BINS], sums[BINS:-1], sums[-1]
    n = scores.sum()
    own_loss, own = unlabelled_sums(first, w, b)
    shift = (np.append(w, b), gradient / n - own / len(first), loss / n - own_loss / len(first))
    unseen = scores - np.bincount(bin_of(first.margins(w, b, np.arange(len(first)))[0]), minlength=BINS)
    unseen = np.maximum(unseen, 0) if n > 2 * len(first) else scores
    above = np.concatenate([np.cumsum(unseen[::-1])[::-1], [0]])[:BINS] / unseen.sum()
    prior = prior_of(held.margins(w, b, np.arange(len(held)))[0], np.arange(BINS) * (2 * REACH / BINS) - REACH, above, int(unseen.sum()))
    w, b = train(Rows(rows[1]), first, prior, seed, shift)
    return w, b, prior


def score(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        w, known = shared.value, Words()
        for batch in batches:
            found = []
            for t in batch.column("text").to_pylist():
                ids = features(t, known)
                found.append(float(sigmoid(float(w[ids] @ values_of(ids)) + bias)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), clean_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    weights, bias, _ = fit(docs, labels, fold("doc_id", FOLDS) != HELD_OUT)
    return score(docs, weights, bias, threshold)
