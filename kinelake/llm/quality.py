"""Quality classifier: Naive Bayes support vectors.

1. A text's indicators are its distinct n-grams, hashed to a fixed number of
   slots: two to four bytes as written, one and two words, and runs of one word
   said two, three, four or eight times over (an n-gram up to the word's name).
2. Spark sums, for each slot, the labelled documents of either class that have
   it; the log ratio of the two shares scales the indicator. Scaled vectors
   have unit length.
3. A linear hinge-loss model is fitted to them by dual coordinate descent, one
   document at a time, and its margin becomes a probability by a logistic curve
   fitted to documents that the descent did not see.

The fit uses at most ``FIT_ROWS`` labelled documents, those with the smallest
hash of their identifier, so what reaches the driver has a fixed bound.
Scoring handles every document alone in its task from a broadcast of 2 ** 20
weights; a lost executor costs its tasks only.

Defined cases: null and empty texts score by the intercept; labels other than
0 and 1 and labels of unknown documents are ignored; without labelled rows of
both classes every score is the share of label 1 (0 without any); a very long text
is scored whole; repeated rows score alike; an empty table gives an empty result; other columns are never
inputs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import labelled_sample, remainder
from .shared import materialise, small_batches, table, utf8
from .textvec import doc_words, mix

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Labelled documents used to fit, at most.
FIT_ROWS = 4000
#: A slot must occur in so many labelled documents to be used.
LEAST_DOCS = 4
RUN_LENGTHS = (2, 3, 4, 8)
PENALTY = 1.0
EPOCHS = 40
CALIBRATE_EVERY = 4  # every fourth document of the sample fits the logistic curve


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def _runs_of_one_word(words: np.ndarray) -> list[int]:
    """Which of RUN_LENGTHS some word reaches by being said again and again."""
    if len(words) < 2:
        return []
    change = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]]))
    longest = int(np.diff(change).max())
    return [n for n in RUN_LENGTHS if longest >= n]


def text_slots(data: np.ndarray, offs: np.ndarray):
    """The distinct slots of each text."""
    n = len(data)
    raw = data.astype(np.uint64)
    grams = []
    for k in (2, 3, 4):
        h = np.full(max(0, n - k + 1), np.uint64(k))
        for j in range(k):
            h = h << np.uint64(8) | raw[j : len(h) + j]
        grams.append(_slot(mix(h)))
    words, first = doc_words(data, offs)
    ones = _slot(mix(words + np.uint64(1)))
    twos = _slot(mix(words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:]))
    runs = {k: int(_slot(mix(np.array([k + 7], np.uint64)))[0]) for k in RUN_LENGTHS}
    seen = np.zeros(SLOTS, np.int32)
    for i in range(len(offs) - 1):
        a, b, u, v = int(offs[i]), int(offs[i + 1]), int(first[i]), int(first[i + 1])
        parts = [g[a : max(a, b - k + 1)] for k, g in zip((2, 3, 4), grams, strict=True)]
        parts += [ones[u:v], twos[u : max(u, v - 1)], np.array([runs[k] for k in _runs_of_one_word(words[u:v])], np.int32)]
        every = np.concatenate(parts)
        order = np.arange(len(every), dtype=np.int32)
        seen[every] = order  # the last place of each slot stands for it
        yield every[seen[every] == order]


def _class_counts(batches):
    counts = np.zeros((2, SLOTS), np.int64)
    for batch in batches:
        data, offs = utf8(batch.column(0))
        for label, slots in zip(batch.column(1).to_pylist(), text_slots(data, offs), strict=True):
            counts[label, slots] += 1
    used = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[0, used]), pa.array(counts[1, used])], ["slot", "neg", "pos"])


def log_count_ratios(sample: DataFrame, n0: int, n1: int) -> np.ndarray:
    """log of the smoothed share of label 1 having a slot over that of label 0; 0 where a slot is too rare to use."""
    counts = sample.select("text", "label").mapInArrow(_class_counts, "slot long, neg long, pos long")
    counts = counts.groupBy("slot").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where(F.col("neg") + F.col("pos") >= LEAST_DOCS)
    found = counts.toPandas()  # SLOTS rows at most
    p, q = found["pos"].to_numpy() + 1.0, found["neg"].to_numpy() + 1.0
    out = np.zeros(SLOTS, np.float32)
    out[found["slot"].to_numpy()] = np.log((p / (n1 + 2)) / (q / (n0 + 2)))
    return out


def _used_slots(ratio):
    def task(batches):
        for batch in batches:
            data, offs = utf8(batch.column(0))
            rows = [np.sort(s[ratio.value[s] != 0]).tobytes() for s in text_slots(data, offs)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.binary())], ["doc_id", "label", "slots"])

    return task


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, penalty: np.ndarray, epochs: int = EPOCHS, seed: int = 5, tolerance: float = 1e-2) -> np.ndarray:
    """Weights and, last, the intercept of the L1-loss support vector machine.

    Each step solves the dual for one document's multiplier in its box and moves the
    weights along that document; an epoch is one pass in a fresh order.
    """
    w, alpha = np.zeros(width + 1), np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            slope = y[i] * (float(w[at] @ v) + w[-1]) - 1
            projected = min(slope, 0.0) if alpha[i] == 0 else max(slope, 0.0) if alpha[i] == penalty[i] else slope
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - slope / norm[i], 0.0), penalty[i])
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
        if worst < tolerance:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the curve that turns margins into probabilities; targets are drawn in from 0 and 1 by the class counts."""
    n1 = float((y > 0).sum())
    n0 = len(y) - n1
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = max(1.0, float(np.abs(step).max()))
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def _score(weights):
    def task(batches):
        ratio, w, bias, slope, offset = weights.value
        for batch in batches:
            data, offs = utf8(batch.column(1))
            scores = []
            for slots in text_slots(data, offs):
                r = ratio[slots].astype(np.float64)
                length = math.sqrt(float(r @ r)) or 1.0
                margin = float(r @ w[slots]) / length + bias
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, slope * margin + offset)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return task


class QualityModel:
    """Log-count ratios, hinge-loss weights and the logistic curve, all of fixed size."""

    def __init__(self, spark: SparkSession, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.ratio, self.weights, self.bias, self.slope, self.offset = ratio, weights, bias, slope, offset
        self._shared = spark.sparkContext.broadcast((ratio, weights, bias, slope, offset))

    @classmethod
    def fit(cls, sample: DataFrame, penalty: float = PENALTY) -> "QualityModel":
        """``sample``: (doc_id, text, label) with label 0 or 1, a bounded set."""
        spark = sample.sparkSession
        small_batches(spark, 500)
        sample = materialise(sample, "quality-sample")
        n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n0, n1 = n.get(0, 0), n.get(1, 0)
        none = np.zeros(SLOTS, np.float32)
        if not n0 or not n1:
            return cls(spark, none, none, 0.0, 1.0, 500.0 if n1 else -500.0)
        ratio = log_count_ratios(sample, n0, n1)
        shared = spark.sparkContext.broadcast(ratio)
        found = sample.select("text", "doc_id", "label").mapInArrow(_used_slots(shared), "doc_id long, label int, slots binary").toArrow()
        found = found.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        rows = [np.frombuffer(s, np.int32) for s in found["slots"].to_pylist()]
        y = np.where(found["label"].to_numpy() == 1, 1.0, -1.0)
        values = [ratio[s].astype(np.float64) for s in rows]
        values = [v / (math.sqrt(float(v @ v)) or 1.0) for v in values]
        # Both classes weigh alike in the descent; the logistic curve restores their shares.
        cost = np.where(y > 0, penalty * len(y) / (2 * n1), penalty * len(y) / (2 * n0))
        learn = np.arange(len(y)) % CALIBRATE_EVERY > 0
        if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
            learn[:] = True
        pick = np.flatnonzero(learn)
        w = dual_coordinate_descent([rows[i] for i in pick], [values[i] for i in pick], y[pick], SLOTS, cost[pick])
        unseen = np.flatnonzero(~learn) if not learn.all() else pick
        margin = np.array([float(w[rows[i]] @ values[i]) + w[-1] for i in unseen])
        slope, offset = logistic_curve(margin, y[unseen])
        return cls(spark, ratio, w[:-1].astype(np.float32), float(w[-1]), slope, offset)

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every row."""
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(self._shared), "doc_id long, score double")


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
    return QualityModel.fit(labelled_sample(docs, labels, "quality", 3, lambda r: r != 1, rows))


NAME = "op1_quality_nbsvm"
SQL = None  # a fitted model has no SQL form; tests check the descent's optimum and held-out accuracy


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = fit_on(docs, table(spark, sf_dir, "labels")).score(docs)
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
