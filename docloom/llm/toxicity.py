"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams. Each n-gram's ratio is the smoothed
log of how much oftener toxic training texts hold it than others do; a logistic model is
fitted on features that are worth their ratio where present. Scoring sums one weight
per distinct n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, in_fold, materialize
from .ngrams import Distinct, code_points, hashed

SIZES, BITS = (4, 5), 20
#: Labelled texts that the model is fitted on, at most; each class has up to half.
MAX_TRAIN_ROWS = 8000
SMOOTH, RIDGE, ROUNDS = 1.0, 1e-4, 80
#: N-grams of fewer training texts, or with a ratio nearer to zero, get no weight.
LEAST_TEXTS, LEAST_RATIO = 3, 1.0


def features(text: str | None, distinct: Distinct, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> np.ndarray:
    """The distinct buckets of a whole lower-cased text, with a space at either end."""
    cps = code_points(f" {(text or '').lower()} ")
    return distinct.of(np.concatenate([hashed(cps, n, bits) for n in sizes]))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[buckets].sum(dtype=np.float64), -30, 30))))


def ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's smoothed log-count ratio, and which buckets are kept: those of enough texts with a ratio far enough from zero."""
    ratio = np.log((toxic + SMOOTH) / (n_toxic + 2 * SMOOTH)) - np.log((clean + SMOOTH) / (n_clean + 2 * SMOOTH))
    return ratio, (toxic + clean >= min(LEAST_TEXTS, n_toxic)) & (np.abs(ratio) >= LEAST_RATIO)


def constant(label: int, bits: int = BITS) -> Model:
    """The model of labels of one class."""
    return Model(np.zeros(1 << bits, np.float32), 30.0 if label else -30.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Model:
    """The model of whole bucket sets, all at hand."""
    size, y = 1 << bits, labels.astype(np.float64)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        return constant(int(len(y) and y[0]), bits)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ratio, kept = ratios(np.bincount(flat, y[owner], size), np.bincount(flat, (1 - y)[owner], size), int(y.sum()), int((1 - y).sum()))
    place = np.cumsum(kept) - 1
    w, bias = logistic([place[r[kept[r]]] for r in rows], y, ratio[kept])
    return _model(kept, ratio, w, bias)


def _model(kept: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> Model:
    weights = np.zeros(len(kept), np.float32)
    weights[kept] = (w * ratio[kept]).astype(np.float32)
    return Model(weights, bias)


def logistic(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-penalised fit by accelerated gradient steps on features worth their ratio; classes weigh alike."""
    n, rows_n = len(ratio), len(y)
    flat = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
    owner = np.repeat(np.arange(rows_n), [len(r) for r in rows])
    value = ratio[flat]
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / rows_n
    times = lambda w: np.bincount(owner, w[:-1][flat] * value, rows_n) + w[-1]
    back = lambda z: np.append(np.bincount(flat, z[owner] * value, n), z.sum())
    top, curve = np.ones(n + 1), 1.0
    for _ in range(12):  # the largest curvature bounds the step
        top = back(times(top) * weigh * 0.25)
        curve = np.linalg.norm(top)
        top /= curve
    step = 1 / (1.1 * curve + RIDGE)
    ridge = np.append(np.full(n, RIDGE), 0.0)
    w, ahead, t = np.zeros(n + 1), np.zeros(n + 1), 1.0
    for _ in range(ROUNDS):
        err = (1 / (1 + np.exp(-np.clip(times(ahead), -30, 30))) - y) * weigh
        new = ahead - step * (back(err) + ridge * ahead)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on labelled documents outside the held-out fold: by hash of the id, at most ``max_rows / 2`` of each class.

    Only the sampled ids meet the documents. Counts of n-grams are summed over tasks, of which the ratios
    are made; then each sampled row becomes its kept buckets, and these, not the texts, go to the
    task that fits, with at most ``max_rows`` rows of at most ``2 ** BITS`` small integers.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~in_fold(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    sample = known.where("toxic = 0").orderBy(*order).limit(max_rows // 2).union(known.where("toxic = 1").orderBy(*order).limit(max_rows // 2))
    texts = documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    texts = materialize(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "sample")
    found = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return constant(max(found, default=0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, sums = Distinct(BITS), np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[toxic, features(text.as_py(), distinct)] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[1, at]), pa.array(sums[0, at])], ["bucket", "toxic", "clean"])

    counts = texts.select("text", "toxic").mapInArrow(count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    held = counts.where(F.col("toxic") + F.col("clean") >= min(LEAST_TEXTS, found[1])).toPandas()
    sums = np.zeros((2, 1 << BITS), np.int64)
    sums[1, held["bucket"]], sums[0, held["bucket"]] = held["toxic"], held["clean"]
    ratio, kept = ratios(sums[1], sums[0], found[1], found[0])
    known_buckets = documents.sparkSession.sparkContext.broadcast((kept, ratio))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, kept = Distinct(BITS), known_buckets.value[0]
        for batch in batches:
            rows = [(x := features(t.as_py(), distinct))[kept[x]].astype(np.int32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["doc_id", "buckets", "toxic"])

    rows = texts.select("doc_id", "text", "toxic").mapInArrow(keep, "doc_id long, buckets binary, toxic int").repartition(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat([*batches]).sort_values("doc_id")
        kept, ratio = known_buckets.value
        place = np.cumsum(kept) - 1
        w, bias = logistic([place[np.frombuffer(b, np.int32)] for b in every["buckets"]], every["toxic"].to_numpy(float), ratio[kept])
        yield pd.DataFrame({"weights": [w.tobytes()], "bias": [bias]})

    made = rows.mapInPandas(run, "weights binary, bias double").collect()[0]
    forget(texts)
    return _model(kept, ratio, np.frombuffer(made["weights"]), made["bias"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null and empty texts have the score of no n-grams."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct(BITS)
        for batch in batches:
            scores = [held.value.score(features(t.as_py(), distinct)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    docs = documents.select(F.col("doc_id").cast("long"), in_fold(F.col("doc_id")).alias("held_out"), "text")
    scored = docs.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Train on ``labels(doc_id, toxic)`` and score every row of ``documents(doc_id, text)``.

    Repeated documents stay; an id labelled twice is toxic if any label is. Null ids, null
    labels and labels other than 0 and 1 are not learned from. N-grams of fewer than ``LEAST_TEXTS`` of the
    training texts, and those whose log-count ratio is within ``LEAST_RATIO`` of zero, have no weight. With no labels, or labels of one
    class, every score is that class's (0 without labels). An empty table gives no rows.
    """
    return score(documents, train(documents, labels, max_rows))
