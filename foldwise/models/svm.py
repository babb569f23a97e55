"""Support vector classifier: a linear machine on an explicit feature map.

A kernel machine needs all pairs of rows. Here the kernel is expressed as a
feature map instead, and a linear machine is trained on it by gradient passes:
linear exactly, poly exactly (all monomials up to its degree), rbf
approximately by random Fourier features (Rahimi & Recht, 2007). The outputs of
a map are made anew in every pass (``hinge``): only the rows' features are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.frame import Frame, col
from foldwise.functions.vectors import VECTOR, first_largest, with_vector
from foldwise.models import hinge
from foldwise.models.base import (INDEX, WEIGHT, as_trained, checked_weights, class_weights,
                                  predictions, training_set, weigh)
from foldwise.models.newton import _margin

KERNELS = ("linear", "poly", "rbf")
# A feature map of so many outputs no longer suits dense vectors.
MAX_MONOMIALS = 20_000
# Outputs of a map that a task holds at a time.
MAPPED_NUMBERS = 2**20


def monomials(n: int, degree: int) -> list[tuple[int, ...]]:
    """The variables of each output of a polynomial expansion, in its order."""
    if degree == 0 or n == 0:
        return [()]
    out: list[tuple[int, ...]] = []
    for power in range(degree + 1):
        out += [m + (n - 1,) * power for m in monomials(n - 1, degree - power)]
    return out


@dataclass(frozen=True)
class FeatureMap:
    kernel: str
    width: int
    gamma: float = 0.0
    degree: int = 3
    coef0: float = 0.0
    directions: np.ndarray | None = None
    phases: np.ndarray | None = None

    @cached_property
    def outputs(self) -> int:
        if self.kernel == "poly":
            return math.comb(self.width + self.degree, self.degree) - 1
        return self.width if self.kernel == "linear" else len(self.phases)

    @cached_property
    def _levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By degree the monomials: one of the degree below, the variable that it is times, and
        the weight.

        (gamma x.y + c)^d is the sum over monomials of degree k <= d of d over k, c^(d - k),
        gamma^k and their multinomial coefficient times both sides' monomials. The constant
        one is an intercept.
        """
        below, levels = {(): 0}, []
        every = [tuple(sorted(m)) for m in monomials(self.width, self.degree)]
        for k in range(1, self.degree + 1):
            own = [m for m in every if len(m) == k]
            weights = [math.sqrt(
                math.factorial(k) / math.prod(math.factorial(n) for n in Counter(m).values())
                * math.comb(self.degree, k) * self.gamma**k * self.coef0**(self.degree - k))
                for m in own]
            levels.append((np.array([below[m[:-1]] for m in own]), np.array([m[-1] for m in own]),
                           np.array(weights)))
            below = {m: i for i, m in enumerate(own)}
        return levels

    def of(self, x: np.ndarray) -> np.ndarray:
        """The outputs for some rows."""
        if self.kernel == "rbf":
            return math.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        if self.kernel == "linear":
            return x
        parts, last = [], np.ones((len(x), 1))
        for lower, variable, weights in self._levels:
            last = last[:, lower] * x[:, variable]
            parts.append(last * weights)
        return np.concatenate(parts, axis=1)

    def at_once(self) -> int:
        """How many rows are mapped at a time."""
        return max(1, MAPPED_NUMBERS // max(1, self.outputs))


def _margins(df: DataFrame, feature_map: FeatureMap, weights: np.ndarray) -> Column:
    """The margin of each machine, from the vectors of ``df``; outputs of the map are not kept."""
    x = vector_to_array(VECTOR)
    if feature_map.kernel == "linear":
        return F.array(*[_margin(x, w) for w in weights])
    step = feature_map.at_once()

    @F.pandas_udf("array<double>")
    def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            if len(xs) == 0:
                yield pd.Series([], dtype=object)
                continue
            rows = np.stack(xs.to_numpy())
            yield pd.Series([m for i in range(0, len(rows), step) for m in
                             feature_map.of(rows[i:i + step]) @ weights[:, :-1].T + weights[:, -1]])

    return margins(x)


@dataclass(frozen=True)
class FittedSVC:
    features: tuple[str, ...]
    classes: tuple
    feature_map: FeatureMap
    # One row a machine, intercept last.
    weights: np.ndarray
    curves: list[tuple[float, float]]

    def predict(self, frame: Frame) -> DataFrame:
        frame = as_trained(frame, self.features)
        df = with_vector(frame)
        df = df.withColumn("__m", _margins(df, self.feature_map, self.weights))
        margins = [F.col("__m")[i] for i in range(len(self.weights))]
        shares = [1.0 / (1.0 + F.exp(-(F.lit(a) * m + F.lit(b))))
                  for m, (a, b) in zip(margins, self.curves)]
        if len(self.classes) == 2:
            proba = F.array(1.0 - shares[0], shares[0])
            index = (margins[0] > 0).cast("int")
        else:
            total = sum(shares[1:], shares[0])
            proba = F.array(*[s / total for s in shares])
            index = first_largest(F.array(*margins))
        return predictions(df, frame.keys, self.classes, proba, index)


class SupportVectorClassifier:
    """Hinge loss, one machine per class against the rest (one if binary).

    Probabilities come from a logistic curve fitted to the training margins
    (Platt), normalised over classes. ``gamma`` is "scale", 1 / (features *
    variance of all matrix entries), "auto", 1 / features, or a number.
    ``class_weight`` is None, "balanced" or a dict; each machine weighs its own
    class and the rest by it.
    """

    def __init__(self, kernel: str = "rbf", C: float = 1.0, max_iter: int = 50,
                 components: int = 256, random_state: int = 0, gamma="scale", degree: int = 3,
                 coef0: float = 0.0, class_weight=None):
        # The hinge has corners: a tighter tolerance only buys line searches.
        if kernel not in KERNELS:
            raise ValueError(f"kernel must be one of {KERNELS}, not {kernel!r}")
        self.kernel, self.C, self.max_iter = kernel, C, max_iter
        self.components, self.random_state = components, random_state
        if gamma not in ("scale", "auto") and not (isinstance(gamma, (int, float)) and gamma > 0):
            raise ValueError(f"gamma must be 'scale', 'auto' or positive, not {gamma!r}")
        if degree < 1 or coef0 < 0:
            raise ValueError("degree must be at least 1 and coef0 not negative")
        self.gamma, self.degree, self.coef0 = gamma, int(degree), float(coef0)
        self.class_weight = checked_weights(class_weight)

    def fit(self, frame: Frame) -> FittedSVC:
        train = training_set(frame)
        feature_map = self._map(frame)
        own = class_weights(train, self.class_weight)
        heavy = sum(n * w for n, w in zip(train.counts, own))
        targets = [1] if len(train.classes) == 2 else list(range(len(train.classes)))
        strength = 1.0 / (self.C * heavy)
        rows = weigh(train, self.class_weight)
        if feature_map.kernel != "linear":
            weights = hinge.fit(rows, train.rows, feature_map, own, targets, strength, self.max_iter)
            return self._fitted(frame, train, feature_map, weights, rows, targets)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            machines = [LinearSVC(
                featuresCol=VECTOR, labelCol="__y", maxIter=self.max_iter, regParam=strength,
                standardization=False, weightCol=WEIGHT, tol=1e-3)
                .fit(rows.withColumn("__y", (F.col(INDEX) == k).cast("double"))) for k in targets]
            weights = np.array([[*m.coefficients.toArray(), m.intercept] for m in machines])
            return self._fitted(frame, train, feature_map, weights, rows, targets)
        finally:
            rows.unpersist()

    def _fitted(self, frame: Frame, train, feature_map: FeatureMap, weights: np.ndarray,
                rows: DataFrame, targets: list[int]) -> FittedSVC:
        scored = rows.select(INDEX, _margins(rows, feature_map, weights).alias("__m"))
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            curves = [self._curve(scored.select(
                (F.col(INDEX) == k).cast("double").alias("__y"), F.col("__m")[i].alias("__m")))
                for i, k in enumerate(targets)]
        finally:
            scored.unpersist()
        return FittedSVC(frame.features, train.classes, feature_map, weights, curves)

    def _curve(self, scored: DataFrame) -> tuple[float, float]:
        margin = array_to_vector(F.array("__m"))
        fitted = LogisticRegression(featuresCol="__mv", labelCol="__y", regParam=0.0).fit(
            scored.select("__y", margin.alias("__mv")))
        return float(fitted.coefficients[0]), float(fitted.intercept)

    def _map(self, frame: Frame) -> FeatureMap:
        d = frame.n_features
        if self.kernel == "linear":
            return FeatureMap("linear", d)
        if self.kernel == "poly" and math.comb(d + self.degree, self.degree) > MAX_MONOMIALS:
            raise ValueError(f"a map of degree {self.degree} of {d} features has more than "
                             f"{MAX_MONOMIALS} outputs; reduce the features or the degree first")
        gamma = {"auto": 1.0 / d}.get(self.gamma, self.gamma)
        gamma = self._gamma(frame) if gamma == "scale" else float(gamma)
        if self.kernel == "poly":
            return FeatureMap("poly", d, gamma, self.degree, self.coef0)
        rng = np.random.default_rng(self.random_state)
        w = rng.normal(0.0, math.sqrt(2.0 * gamma), (d, self.components))
        return FeatureMap("rbf", d, gamma, 0, 0.0, w, rng.uniform(0.0, 2.0 * math.pi, self.components))

    @staticmethod
    def _gamma(frame: Frame) -> float:
        row = frame.df.agg(*[f(col(n).cast("double")).alias(f"{t}{i}")
                             for i, n in enumerate(frame.features)
                             for t, f in (("a", F.avg), ("v", F.var_pop))]).first()
        d = frame.n_features
        means = [row[f"a{i}"] for i in range(d)]
        grand = sum(means) / d
        spread = sum(row[f"v{i}"] + (means[i] - grand) ** 2 for i in range(d)) / d
        return 1.0 / (d * spread) if spread > 0 else 1.0
