"""Linear classifiers by distributed proximal gradient, and ridge by normal equations.

Labels are +-1. A gradient is one pass: every task gives one vector of sums, added up on the way to the driver, which holds nothing larger than
features x features. Steps are those of accelerated proximal gradient with the step length from the largest eigenvalue of the Gram matrix;
the L1 term is met exactly by soft thresholding, so weights become true zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.sources.scratch import stored

#: Width over which the hinge's corner is rounded.
ROUND = 0.1


def squared_hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its derivative by the margin y * (w x + b)."""
    short = np.maximum(0, 1 - margin)
    return short**2, -2 * short


def hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hinge with its corner rounded over ROUND."""
    short = 1 - margin
    inside = (short > 0) & (short < ROUND)
    return np.where(inside, short**2 / (2 * ROUND), np.maximum(0, short - ROUND / 2)), np.where(inside, -short / ROUND, -(short >= ROUND).astype(float))


#: Loss and the largest second derivative of it.
LOSSES = {"squared_hinge": (squared_hinge, 2.0), "hinge": (hinge, 1 / ROUND)}


def as_rows(data: DataFrame, features: str, label: str) -> DataFrame:
    """(x, y): features as an array, labels 0 and 1 as -1 and 1."""
    return data.select(vector_to_array(features).alias("x"), (2 * F.col(label).cast("double") - 1).alias("y"))


def _sums(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over rows of a function from (X with a column of ones, y) to a fixed-length array."""

    def run(batches):
        total = None
        for got in batches:
            if got.num_rows:
                x = np.array(got.column(0).flatten()).reshape(got.num_rows, -1)
                part = of(np.c_[x, np.ones(len(x))], np.array(got.column(1)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "s"])

    parts = rows.mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").toArrow()
    return parts.column("s").to_numpy()


def gram(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, X'X, X'y), X with a column of ones."""
    flat = _sums(rows, lambda x, y: np.concatenate([(x.T @ x).reshape(-1), x.T @ y]))
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    square, right = flat[: d * d].reshape(d, d), flat[d * d :]
    return int(round(square[-1, -1])), square, right


@dataclass
class Fitted:
    """A decision function w x + b over features, perhaps only some of them."""

    w: np.ndarray
    b: float
    features: str = "features"
    steps: int = 0

    def decision(self) -> Column:
        terms = [F.lit(float(w)) * F.element_at("_x", i + 1) for i, w in enumerate(self.w) if w]
        out = F.lit(float(self.b))
        for t in terms:
            out = out + t
        return out

    def transform(self, data: DataFrame) -> DataFrame:
        rows = data.withColumn("_x", vector_to_array(self.features))
        return rows.withColumn("decision", self.decision()).withColumn("prediction", (F.col("decision") > 0).cast("double")).drop("_x")


@dataclass
class Ridge:
    """Least squares on labels of +-1 with alpha * |w|^2; the intercept is free."""

    alpha: float = 1.0
    features: str = "features"
    label: str = "label"

    def fit(self, data: DataFrame) -> Fitted:
        n, square, right = gram(as_rows(data, self.features, self.label))
        mean, mean_y = square[-1, :-1] / n, right[-1] / n
        centred = square[:-1, :-1] - n * np.outer(mean, mean)
        w = np.linalg.solve(centred + self.alpha * np.eye(len(mean)), right[:-1] - n * mean * mean_y)
        return Fitted(w, float(mean_y - mean @ w), self.features)


@dataclass
class ProximalLinear:
    """Minimises mean loss + strength * (l1 * |w|_1 + (1 - l1) / 2 * |w|^2); the intercept is free."""

    loss: str = "squared_hinge"
    strength: float = 0.01
    l1: float = 1.0
    max_iter: int = 200
    tol: float = 1e-5
    features: str = "features"
    label: str = "label"
    #: Places of the features to use; None for all.
    support: list[int] | None = field(default=None)

    def fit(self, data: DataFrame) -> Fitted:
        rows = as_rows(data, self.features, self.label)
        rows = stored(data.sparkSession, rows if self.support is None else rows.select(F.array(*(F.element_at("x", i + 1) for i in self.support)).alias("x"), "y"), "rows")
        n, square, _ = gram(rows)
        of, curve = LOSSES[self.loss]
        l2, l1 = self.strength * (1 - self.l1), self.strength * self.l1
        step = 1 / (curve * float(np.linalg.eigvalsh(square / n)[-1]) + l2)
        z = w = np.zeros(len(square))
        t = 1.0
        for done in range(1, self.max_iter + 1):
            gradient = _sums(rows, lambda x, y, z=z: x.T @ (y * of(y * (x @ z))[1])) / n
            gradient[:-1] += l2 * z[:-1]
            new = z - step * gradient
            new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * l1)
            moved = np.abs(new - z).max() / step
            if (new - w) @ (z - new) > 0:  # momentum points uphill: begin anew
                t = 1.0
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, w, t = new + (t - 1) / after * (new - w), new, after
            if moved < self.tol:
                break
        whole = w[:-1]
        if self.support is not None:
            size = len(data.select(vector_to_array(self.features)).first()[0])
            whole = np.zeros(size)
            whole[self.support] = w[:-1]
        return Fitted(whole, float(w[-1]), self.features, done)


@dataclass
class SelectThenFit:
    """The features that an L1 fit keeps, then a fit with an L2 term on them alone."""

    first: ProximalLinear
    second: ProximalLinear

    def fit(self, data: DataFrame) -> Fitted:
        kept = [int(i) for i in np.flatnonzero(self.first.fit(data).w)]
        if not kept:  # nothing but the intercept
            kept = [0]
        second = ProximalLinear(**{**self.second.__dict__, "support": kept})
        return second.fit(data)
