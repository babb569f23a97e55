"""Fewer features: principal components and recursive elimination."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import PCA, VectorSlicer
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwise.frame import Frame, col, quoted
from foldwise.functions.vectors import VECTOR, feature_array, with_vector
from foldwise.models import newton
from foldwise.models.base import INDEX, training_set
from foldwise.models.cells import DRIVER_NUMBERS, TrainSide, gather
from foldwise.models.linear import LogisticClassifier
from foldwise.operators.base import Projection, check_numeric


# Up to here covariances are plain aggregates and projections plain arithmetic.
MAX_PLAIN_FEATURES = 24


@dataclass(frozen=True)
class FittedComponents:
    """Feature means and, per component, its loadings."""

    means: np.ndarray
    loadings: np.ndarray  # features x components

    def apply(self, frame: Frame) -> Frame:
        if frame.n_features <= MAX_PLAIN_FEATURES:
            return frame.rebuild({f"PC{k}": self._arithmetic(frame, k)
                                  for k in range(self.loadings.shape[1])})
        means, loadings = self.means, self.loadings

        @F.pandas_udf("array<double>")
        def project(rows: pd.Series) -> pd.Series:
            if len(rows) == 0:
                return rows
            return pd.Series(list((np.stack(rows.to_numpy()) - means) @ loadings))

        scored = frame.df.select(*[col(k) for k in frame.keys],
                                 project(feature_array(frame)).alias("__pc"))
        keyed = Frame(scored, (), frame.keys, frame.row_id, frame.label)
        return keyed.rebuild({f"PC{k}": F.col("__pc")[k] for k in range(loadings.shape[1])})

    def _arithmetic(self, frame: Frame, k: int) -> Column:
        terms = [f"(CAST({quoted(n)} AS DOUBLE) - {float(m)!r}D) * {float(w)!r}D"
                 for n, m, w in zip(frame.features, self.means, self.loadings[:, k])]
        missing = " OR ".join(f"{quoted(n)} IS NULL" for n in frame.features)
        return F.expr(f"CASE WHEN {missing} THEN CAST(raise_error('features hold nulls; impute "
                      f"them first') AS DOUBLE) ELSE {' + '.join(terms)} END")


class PrincipalComponents:
    """Replace all features by components PC0, PC1, ...

    ``proportion`` is a share of variance to explain if it is a float in (0, 1)
    and a number of components if it is an integer. The largest loading of a
    component is positive, so its sign is determined.
    """

    tunable = ("proportion",)

    def __init__(self, proportion: float | int = 0.7):
        if isinstance(proportion, float) and not 0.0 < proportion < 1.0:
            raise ValueError("a float proportion must lie in (0, 1)")
        self.proportion = proportion

    def fit(self, frame: Frame) -> FittedComponents:
        d = frame.n_features
        check_numeric(frame, list(frame.features), "a component analysis")
        means, shares, loadings = (self._plain(frame) if d <= MAX_PLAIN_FEATURES
                                   else self._gram(frame))
        k = self.proportion
        if isinstance(k, float):
            k = min(int(np.searchsorted(np.cumsum(shares), k, side="right")) + 1, d)
        if not 1 <= k <= d:
            raise ValueError(f"cannot keep {k} components of {d} features")
        loadings = loadings[:, :k]
        largest = loadings[np.abs(loadings).argmax(axis=0), range(k)]
        return FittedComponents(means, loadings * np.where(largest < 0, -1.0, 1.0))

    @staticmethod
    def _plain(frame: Frame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means and all covariances in one pass; the rest is a small eigen-solve."""
        d = frame.n_features
        x = [f"CAST({quoted(n)} AS DOUBLE)" for n in frame.features]
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = frame.df.agg(
            *[F.expr(f"count_if({v} IS NULL)").alias(f"n{i}") for i, v in enumerate(x)],
            *[F.expr(f"avg({v})").alias(f"m{i}") for i, v in enumerate(x)],
            *[F.expr(f"covar_pop({x[i]}, {x[j]})").alias(f"c{i}_{j}") for i, j in pairs]).first()
        empty = [n for i, n in enumerate(frame.features) if row[f"n{i}"]]
        if empty:
            raise ValueError(f"features hold nulls; impute them first: {empty}")
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
        variances, vectors = np.linalg.eigh(cov)
        variances, vectors = np.maximum(variances[::-1], 0.0), vectors[:, ::-1]
        total = variances.sum()
        shares = variances / total if total > 0 else np.full(d, 1.0 / d)
        return np.array([row[f"m{i}"] for i in range(d)]), shares, vectors

    @staticmethod
    def _gram(frame: Frame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Many features: Spark's own distributed covariance and decomposition."""
        vectors = with_vector(frame)
        full = PCA(k=frame.n_features, inputCol=VECTOR, outputCol="__pcv").fit(vectors)
        means = vectors.select(Summarizer.mean(F.col(VECTOR)).alias("m")).first()["m"]
        shares, d = full.explainedVariance.toArray(), frame.n_features
        if not np.isfinite(shares).all() or shares.sum() <= 0:
            shares = np.full(d, 1.0 / d)  # no variance at all, as in the plain way
        return means.toArray(), shares, full.pc.toArray()


@dataclass(frozen=True)
class FittedSelection(Projection):
    names: tuple[str, ...]

    def columns(self, frame: Frame) -> dict[str, Column]:
        return {n: col(n) for n in self.names}


class RecursiveElimination:
    """Fit a logistic regression, drop the weakest feature, repeat.

    Weakest is the smallest sum over classes of squared coefficients. Keeps
    ``int(features * proportion)`` features, at least one, in table order.
    """

    tunable = ("proportion",)

    def __init__(self, proportion: float | int = 0.7):
        self.proportion = proportion

    def keep(self, n: int) -> int:
        if isinstance(self.proportion, int):
            return min(self.proportion, n)
        return max(1, int(n * self.proportion))

    def fit(self, frame: Frame) -> FittedSelection:
        n = frame.n_features
        if n == 1:
            warnings.warn("a single feature cannot be eliminated", stacklevel=2)
            return FittedSelection(frame.features)
        left = list(range(n))
        if self.keep(n) >= n:
            return FittedSelection(frame.features)
        learner = LogisticClassifier("l2", l2_c=1.0)
        rows = gather({0: TrainSide(frame)}, packed=True)
        try:
            if newton.numbers(rows.cells[0]) <= DRIVER_NUMBERS:
                left = newton.eliminate(rows, 0, learner.strength(), self.keep(n))
                return FittedSelection(tuple(frame.features[i] for i in left))
        finally:
            rows.release()
        # A Hessian too wide for the driver: gradients only, every fit from the start.
        train = training_set(frame)
        base = train.df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            while len(left) > self.keep(n):
                view = VectorSlicer(inputCol=VECTOR, outputCol="__left", indices=left)
                model = (learner.estimator(train.rows, len(left)).setFeaturesCol("__left")
                         .setLabelCol(INDEX).fit(view.transform(base)))
                weight = np.square(model.coefficientMatrix.toArray()).sum(axis=0)
                left.pop(int(np.argmin(weight)))
        finally:
            base.unpersist()
        return FittedSelection(tuple(frame.features[i] for i in left))
