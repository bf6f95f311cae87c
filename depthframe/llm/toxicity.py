"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Fitting, on labelled texts: every hashed n-gram f gets r(f) = log of its smoothed share among toxic texts over its share
among the others; the feature of a text that holds f is r(f), and a logistic regression with an L2 penalty weighs these.
Rows of the rarer label weigh as much together as the others, tempered by ``BALANCE``. The intercept is then set so that
the threshold of the result, ``THRESHOLD``, separates best.

Scoring, on all texts: the product of weight and ratio of each n-gram is one number, so a model is one vector of
``2**BITS`` numbers whatever the data, sent to the tasks by closure. A text is scored by the sum over the n-grams that
it holds, each once. The sum follows its words, not its length: n-grams with no bearing have weights near zero.

Spark counts the n-grams of the labelled sample (``sampling.SAMPLE_ROWS``): at most ``2**BITS`` counts come to the driver.
Of each row of the sample the driver then gathers which of the ``FEATURES`` chosen n-grams it holds, a bit for each, so
what it gathers has a bound whatever the lengths of the texts.

Defined cases: null text is empty; bytes that are no UTF-8 count as U+FFFD; an empty text gets the score of the intercept; very long texts are hashed in steps and
scored whole; without labels, or with one label only, every score is the share of that label (0 if none); equal rows
have equal scores; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, text_slices, valid_text
from .sampling import SAMPLE_ROWS, held_out, training_rows

ORDERS = (4, 5, 6)
BITS = 18
#: Code points hashed at once.
STEP = 1 << 16
SMOOTHING = 1.0
#: The n-grams that tell most between the labels take part; the others would get next to no weight.
FEATURES = 8_000
PENALTY = 1e-5
ROUNDS = 200
BALANCE = 0.5
THRESHOLD = 0.3

_BASE = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of the lower-cased text between two spaces; ``seen`` is an all-false table, left so."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    # Any white space is one blank.
    codes[(codes >= 9) & (codes <= 13)] = 32
    for a in range(0, len(codes), STEP):
        part = codes[a : a + STEP + max(ORDERS) - 1]
        rolling = np.zeros(len(part), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            rolling = rolling[:size] * _BASE + part[n - 1 :]
            if n in ORDERS:
                seen[(mix64(rolling + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[found].sum(dtype=np.float64), -40, 40))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << BITS, bool)
    for batch in text_slices(batches, "text"):
        found = [ngrams(t, seen).astype(np.int32) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array([f.tobytes() for f in found], pa.binary())], names=["doc_id", "label", "found"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a task: how many of each label hold each n-gram."""
    held = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for f, k in zip(batch["found"].to_pylist(), batch["label"].to_pylist(), strict=True):
            held[k][np.frombuffer(f, np.int32)] += 1  # a text holds each of its n-grams once
    at = np.flatnonzero(held.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[0][at]), pa.array(held[1][at])], names=["ngram", "clean", "toxic"])


def choose(held: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the n-grams that take part, the log-count ratios of all), from the rows of each label that hold each n-gram and the
    rows of each label."""
    size = held.shape[1]
    share = [(held[k] + SMOOTHING) / (held[k].sum() + SMOOTHING * size) for k in (0, 1)]
    ratio = np.log(share[1]) - np.log(share[0])
    gap = held[1] / total[1] - held[0] / total[0]
    both = (held[0] + held[1] + 1) / (total.sum() + 2)
    telling = gap * gap / (both * (1 - both))
    return np.sort(np.argsort(-telling, kind="stable")[:FEATURES]), ratio


def _chosen(kept: np.ndarray):
    """Which of the chosen n-grams each row holds, a bit for each."""
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for f in batch["found"].to_pylist():
                holds = np.zeros(len(kept), bool)
                at = place[np.frombuffer(f, np.int32)]
                holds[at[at >= 0]] = True
                bits.append(np.packbits(holds).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(bits, pa.binary())], names=["doc_id", "label", "bits"])

    return run


def fit_bits(bits: np.ndarray, label: np.ndarray, kept: np.ndarray, ratio: np.ndarray) -> Model:
    """The model of rows given as truth tables over the chosen n-grams and 0/1 labels."""
    total = np.bincount(label, minlength=2)
    rows, columns = np.nonzero(bits)
    values = ratio[kept][columns]
    weight = np.where(label == 1, (total[0] / total[1]) ** BALANCE, 1.0)
    weight /= weight.sum()
    norm = np.sqrt((np.bincount(rows, values * values, len(bits)) * weight).sum())
    values, size = values / norm, len(kept)
    # Accelerated gradient descent. Weights sum to 1 and so do the weighted squares of the features: the loss bends by
    # (1 + 1) / 4 at most.
    w = y = np.zeros(size)
    bias = by = 0.0
    t, rate = 1.0, 2.0
    for _ in range(ROUNDS):
        margin = np.bincount(rows, y[columns] * values, len(bits)) + by
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label) * weight
        w_next = y - rate * (np.bincount(columns, error[rows] * values, size) + PENALTY * y)
        bias_next = by - rate * error.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, by = w_next + (t - 1) / t_next * (w_next - w), bias_next + (t - 1) / t_next * (bias_next - bias)
        w, bias, t = w_next, bias_next, t_next
    margin = np.bincount(rows, w[columns] * values, len(bits)) + bias
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w * ratio[kept] / norm
    return Model(weights, float(bias + _shift(margin, label)))


def _shift(margin: np.ndarray, label: np.ndarray) -> float:
    """What to add to the margins so that THRESHOLD separates the labels best (by F1; the middle of the best gap)."""
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + label.sum())
    k = int(f1.argmax())
    low = margin[order[k + 1]] if k + 1 < len(order) else margin[order[k]] - 2.0
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (margin[order[k]] + low) / 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    rows = training_rows(docs, labels, label, sample_rows).mapInArrow(_features, "doc_id long, label int, found binary")
    rows = materialize(rows, "toxicity-sample")
    total = np.zeros(2, np.int64)
    for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect():
        total[r.label] = r.n
    if not total.all():
        share = float(total[1] / total.sum()) if total.any() else 0.0
        return Model(np.zeros(1 << BITS, np.float32), 40.0 * (2 * share - 1))
    counts = rows.mapInArrow(_counts, "ngram int, clean long, toxic long").groupBy("ngram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    held = np.zeros((2, 1 << BITS))
    held[:, np.asarray(counts["ngram"])] = np.asarray(counts["clean"]), np.asarray(counts["toxic"])
    kept, ratio = choose(held, total)
    rows = sorted(tuple(r) for r in rows.mapInArrow(_chosen(kept), "doc_id long, label int, bits binary").toLocalIterator())
    bits = np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), axis=1, count=len(kept))
    return fit_bits(bits, np.array([r[1] for r in rows], np.int64), kept, ratio)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for batch in text_slices(batches, "text"):
            scores = [model.score(ngrams(t, seen)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scored = score(docs, fit(docs, labels, "toxic", sample_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
