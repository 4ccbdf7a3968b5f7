"""Quality classifier: a linear model on n-gram indicators scaled by naive Bayes log-count ratios.

Features are the byte n-grams of a text (2 to 4 bytes, case kept) in ``DIMENSIONS`` hashed cells, present or absent. Each is scaled
by its log-count ratio between the classes, rows have length one, and a hinge-loss model is fitted by dual coordinate descent. A
sigmoid fitted on rows kept apart from the fit turns margins into scores from 0 to 1.

The fit reads labelled rows only, at most ``max_rows`` of them, chosen by a hash of their id; that bound is what may be broadcast and
sent to the driver. Everything is scored, whole texts, where it lies. An empty or missing text has no features and gets the
score of the bias alone. Rows with conflicting labels count by majority, a tie as 1; labels that are null are left out.
Of rows that repeat a doc_id one is used for the fit; all are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 18
MAX_ROWS = 4000
SIZES = (2, 3, 4)
_SPREAD = np.uint32(2654435769)


class Cells:
    """Which hashed cells the n-grams of a text fall in."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.seen = np.zeros(dimensions, bool)
        self.shift = np.uint32(32 - (dimensions.bit_length() - 1))

    def of(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
        gram = raw.copy()
        for size in range(2, max(SIZES) + 1):
            if len(raw) < size:
                break
            gram = (gram[:len(raw) - size + 1] << np.uint32(8)) | raw[size - 1:]
            if size in SIZES:
                self.seen[((gram + np.uint32(size)) * _SPREAD) >> self.shift] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, dimensions: int = DIMENSIONS, alpha: float = 1.0) -> np.ndarray:
    """log of the classes' smoothed, normalised indicator counts."""
    counts = np.full((2, dimensions), alpha)
    for row, label in zip(rows, labels):
        counts[int(label), row] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def scaled(row: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[row]
    norm = np.sqrt(values @ values)
    return values / norm if norm > 0 else values


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, dimensions: int = DIMENSIONS, cost: float = 1.0,
              epochs: int = 20, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear machine, with the bias as a feature of value one.

    Both classes weigh the same in all: a row's box is its cost times what balances the classes.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    sides = np.bincount(labels, minlength=2)
    box = cost * len(labels) / (2.0 * np.maximum(sides[labels], 1))
    weights, bias = np.zeros(dimensions), 0.0
    dual = np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(dual[i] - gradient / square[i], 0.0), box[i])
            step = new - dual[i]
            if step:
                dual[i] = new
                weights[rows[i]] += step * sign[i] * values[i]
                bias += step * sign[i]
                worst = max(worst, abs(step))
        if worst < tolerance:
            break
    return weights, bias


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, offset) of a logistic curve through margins and labels, by Newton's method with softened targets."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1.0) / (ones + 2.0), 1.0 / (len(labels) - ones + 2.0))
    slope, offset = 1.0, 0.0
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * np.array([slope, offset]))
        size = np.abs(step).max()
        step *= min(1.0, 5.0 / size) if size else 1.0
        slope, offset = slope - step[0], offset - step[1]
        if size < 1e-6:
            break
    return float(slope), float(offset)


class Model:
    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.ratios, self.weights = ratios.astype(np.float32), weights.astype(np.float32)
        self.bias, self.slope, self.offset = bias, slope, offset

    def margin(self, row: np.ndarray) -> float:
        values = self.ratios[row].astype(np.float64)
        norm = np.sqrt(values @ values)
        return float(values @ self.weights[row]) / norm + self.bias if norm > 0 else self.bias

    def score(self, row: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(row) + self.offset, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows of ``docs``; a fifth of them sets the sigmoid."""
    chosen = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
              .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Cells()
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "cells": [own.of(t).tobytes() for t in frame["text"]]})

    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows narrow rows
            .mapInPandas(cells, "doc_id long, label int, cells binary").groupBy("doc_id", "label").agg(F.min("cells").alias("cells"))
            .toPandas().sort_values("doc_id"))
    found = [np.frombuffer(x, np.int32) for x in rows["cells"]]
    label = rows["label"].to_numpy(np.int64)
    if not len(found):
        return Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 1.0, 0.0)
    apart = np.arange(len(found)) % 5 == 4
    fit = np.flatnonzero(~apart)
    ratios = log_count_ratios([found[i] for i in fit], label[fit])
    weights, bias = fit_hinge([found[i] for i in fit], [scaled(found[i], ratios) for i in fit], label[fit])
    model = Model(ratios, weights, bias, 1.0, 0.0)
    test = np.flatnonzero(apart) if apart.any() else fit
    model.slope, model.offset = fit_sigmoid(np.array([model.margin(found[i]) for i in test]), label[test])
    return model


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score of the whole text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Cells()
        for texts in batches:
            yield pd.Series([model.score(own.of(t)) for t in texts], dtype="float64")

    return docs.withColumn(column, score("text"))


def fold(id_column: str = "doc_id", parts: int = 4):
    """crc32 of the id's decimal text, modulo ``parts``; a missing id is the empty text."""
    return (F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % parts).cast("int")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 2, parts: int = 4, max_rows: int = MAX_ROWS) -> DataFrame:
    """All columns of ``docs`` with held_out, score and predicted; labels of the held-out fold are not read for the fit."""
    model = learn(docs, labels.where(fold("doc_id", parts) != held_out), max_rows)
    scored = score_documents(docs, model, "score")
    return (scored.withColumn("held_out", fold("doc_id", parts) == held_out)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
