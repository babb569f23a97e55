"""Boosted stumps of many cells at once, from weighted histograms.

A round is one job: tasks sum the rows' weights by (cell, feature, bin, class),
Spark adds them, and the driver picks each cell's best split. The weighted error
of a stump follows from the same sums, so no further pass is needed.

A row's weight is e to the votes of the stumps that missed it, divided by the
mean weight, which is known from the errors. Votes of rounds that are over are
written to the shared folder with the rows every ``ROUNDS_A_WRITE`` rounds, so
neither the work of a round nor the lineage grows.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.frame import Frame
from foldwise.functions.vectors import VECTOR, with_vector
from foldwise.models.base import as_trained, predictions
from foldwise.models.cells import Cell, CellRows, TrainSide, gather, summed, waves
from foldwise.session import scratch_dir

ROUNDS_A_WRITE = 10
# Points of each feature's distribution in a slice, from which bins are made.
POINTS = 255
# Splits whose impurities differ by less than this share are tied: the first wins.
TIE = 1e-12


@dataclass(frozen=True)
class Stump:
    """A split on one feature with a class on each side, and its vote."""

    feature: int
    threshold: float
    left: int
    right: int
    weight: float = 0.0

    def chosen(self, values: Column) -> Column:
        if self.feature < 0:
            return F.lit(self.left)
        return F.when(values[self.feature] <= F.lit(self.threshold),
                      F.lit(self.left)).otherwise(F.lit(self.right))

    def missed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return y != self.left
        return y != np.where(x[:, self.feature] <= self.threshold, self.left, self.right)


def _votes(stumps: list[Stump], values: Column, n_classes: int) -> list[Column]:
    """Per class the weights of the stumps that chose it."""
    out = []
    for k in range(n_classes):
        total = F.lit(0.0)
        for s in stumps:
            total = total + F.when(s.chosen(values) == F.lit(k), F.lit(s.weight)).otherwise(0.0)
        out.append(total)
    return out


@dataclass(frozen=True)
class FittedBoost:
    stumps: list[Stump]
    classes: tuple
    features: tuple[str, ...]

    def predict(self, frame: Frame) -> DataFrame:
        frame = as_trained(frame, self.features)
        k = len(self.classes)
        df = with_vector(frame).withColumn("__x", vector_to_array(VECTOR))
        total = sum(s.weight for s in self.stumps)
        votes = F.array(*_votes(self.stumps, F.col("__x"), k))
        # A vote counts 1 for its class and -1/(K-1) for each other class.
        df = df.withColumn("__v", votes).withColumn("__score", F.transform(
            "__v", lambda v: (v - (F.lit(total) - v) / (k - 1)) / F.lit(total) / max(k - 1, 1)))
        df = df.withColumn("__e", F.transform("__score", lambda s: F.exp(s)))
        sums = F.aggregate("__e", F.lit(0.0), lambda a, b: a + b)
        return predictions(df, frame.keys, self.classes,
                           F.transform("__e", lambda e: e / sums))


class BoostClassifier:
    """Multi-class boosting of depth-1 trees (SAMME, Zhu et al. 2009).

    Stumps split on the least weighted Gini impurity over at most ``max_bins``
    bins a feature; of equal splits the first feature and threshold wins.
    """

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0,
                 max_bins: int = 32, random_state: int = 0):
        if n_estimators < 1 or learning_rate <= 0:
            raise ValueError("n_estimators and learning_rate must be positive")
        if max_bins < 2:
            raise ValueError("max_bins must be at least 2")
        self.n_estimators, self.learning_rate = n_estimators, learning_rate
        self.max_bins, self.random_state = max_bins, random_state

    def fit(self, frame: Frame) -> FittedBoost:
        return self.fit_cells({0: (self, TrainSide(frame))})[0]

    @staticmethod
    def fit_cells(parts: dict[Hashable, tuple["BoostClassifier", TrainSide]]) -> dict:
        """Fit many cells together, a job a round for all of them."""
        rows = gather({key: learn for key, (_, learn) in parts.items()})
        try:
            cuts = thresholds(rows, {key: model.max_bins for key, (model, _) in parts.items()})
            boosts = {key: _Boost(rows.cells[key], model, cuts[key])
                      for key, (model, _) in parts.items()}
            _run(rows, boosts)
        finally:
            rows.release()
        return {key: FittedBoost(b.stumps, b.cell.classes, b.cell.features)
                for key, b in boosts.items()}


def thresholds(rows: CellRows, max_bins: dict[Hashable, int]) -> dict[Hashable, list[np.ndarray]]:
    """For each cell and feature the values to split at, from its own rows.

    Each slice tells points of its distribution and its ends, in one job; a
    cell's bins are quantiles of the points of its slices, weighted by rows.
    """
    shares = [(i + 0.5) / POINTS for i in range(POINTS)]
    long = rows.df.select("source", "slice", F.posexplode("x").alias("f", "value"))
    found = long.groupBy("source", "slice", "f").agg(
        F.percentile_approx("value", shares, 4 * POINTS).alias("points"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))
    by_source: dict[int, list] = {}
    for r in found.collect():
        points = np.array([*r["points"], r["least"], r["most"]])
        weights = np.append(np.full(POINTS, r["n"] / POINTS), [0.0, 0.0])
        by_source.setdefault(r["source"], []).append((r["slice"], r["f"], points, weights))
    out = {}
    for key, cell in rows.cells.items():
        own: list[list] = [[] for _ in cell.features]
        for at, f, points, weights in by_source[cell.source]:
            if cell.slices is None or at in cell.slices:
                own[f].append((points, weights))
        out[key] = [_cuts(np.concatenate([p for p, _ in part]), np.concatenate([w for _, w in part]),
                          max_bins[key]) for part in own]
    return out


def _cuts(points: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between values: all of them if they are few, else at even quantiles."""
    values, which = np.unique(points, return_inverse=True)
    if len(values) > bins:
        share = np.cumsum(np.bincount(which, weights))
        at = np.searchsorted(share, share[-1] * np.arange(1, bins) / bins)
        at = np.unique(np.minimum(at, len(values) - 2))
    else:
        at = np.arange(len(values) - 1)
    return (values[at] + values[at + 1]) / 2


@dataclass
class _Boost:
    """The stumps of a cell so far."""

    cell: Cell
    model: BoostClassifier
    cuts: list[np.ndarray]
    stumps: list[Stump] = field(default_factory=list)
    # Log of the mean weight, and how many stumps' votes are in the column v.
    shift: float = 0.0
    written: int = 0
    done: bool = False

    @property
    def bins(self) -> int:
        return 1 + max(len(c) for c in self.cuts)

    @property
    def numbers(self) -> int:
        return len(self.cuts) * self.bins * len(self.cell.classes)

    def logged(self, x: np.ndarray, y: np.ndarray, v: np.ndarray | None) -> np.ndarray:
        """Votes of the stumps that missed each row."""
        total = np.zeros(len(x)) if v is None else v.copy()
        for s in self.stumps[self.written:]:
            total[s.missed(x, y)] += s.weight
        return total

    def histogram(self, x: np.ndarray, y: np.ndarray, v: np.ndarray | None) -> np.ndarray:
        """Weights by feature, bin and class."""
        k, bins = len(self.cell.classes), self.bins
        weights = np.exp(self.logged(x, y, v) - self.shift)
        return np.concatenate([
            np.bincount(np.searchsorted(cuts, x[:, f]) * k + y, weights, minlength=bins * k)
            for f, cuts in enumerate(self.cuts)])

    def take(self, sums: np.ndarray) -> None:
        """Add the best stump for these weights, or stop."""
        k = len(self.cell.classes)
        stump, error = self._best(sums.reshape(len(self.cuts), self.bins, k))
        if error <= 0:
            self.stumps.append(replace(stump, weight=1.0))
            self.done = True
            return
        if error >= 1.0 - 1.0 / k:
            if not self.stumps:
                raise ValueError("the first stump is no better than chance")
            self.done = True
            return
        vote = self.model.learning_rate * (math.log((1.0 - error) / error) + math.log(k - 1.0))
        self.stumps.append(replace(stump, weight=vote))
        self.shift += math.log((1.0 - error) + error * math.exp(vote))
        self.done = len(self.stumps) >= self.model.n_estimators

    def _best(self, weights: np.ndarray) -> tuple[Stump, float]:
        """The split of least impurity, and the share of weight that it misses."""
        every = weights[0].sum(axis=0)
        total = every.sum()
        whole = total - (every ** 2).sum() / total
        left = np.cumsum(weights, axis=1)[:, :-1]
        right = every - left
        mass = left.sum(axis=2), right.sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = sum(m - (side ** 2).sum(axis=2) / m for m, side in zip(mass, (left, right)))
        impurity[(mass[0] <= TIE * total) | (mass[1] <= TIE * total)] = np.inf
        for f, cuts in enumerate(self.cuts):
            impurity[f, len(cuts):] = np.inf
        least = impurity.min() if impurity.size else np.inf
        if not least < whole - TIE * total:
            k = int(every.argmax())
            return Stump(-1, 0.0, k, k), 1.0 - every[k] / total
        f, b = np.unravel_index(int((impurity <= least + TIE * total).argmax()), impurity.shape)
        a, z = int(left[f, b].argmax()), int(right[f, b].argmax())
        missed = total - left[f, b, a] - right[f, b, z]
        return (Stump(int(f), float(self.cuts[f][b]), a, z),
                0.0 if missed <= TIE * total else missed / total)


def _run(rows: CellRows, boosts: dict[Hashable, _Boost]) -> None:
    """Rounds until every cell is done."""
    first, rounds = rows, 0
    while True:
        active = [key for key, b in boosts.items() if not b.done]
        if not active:
            break
        if rounds and rounds % ROUNDS_A_WRITE == 0:
            rows = _write_votes(rows, boosts)
            if rounds == ROUNDS_A_WRITE:
                first.release()
        for wave in waves(active, lambda key: boosts[key].numbers):
            own = {key: boosts[key] for key in wave}

            def work(key, cell, x, y, v, own=own):
                return own[key].histogram(x, y, v)

            for key, sums in summed(rows, wave, work).items():
                boosts[key].take(sums)
        rounds += 1


def _write_votes(rows: CellRows, boosts: dict[Hashable, _Boost]) -> CellRows:
    """The rows with all votes so far in the column v, written and read back."""
    by_source: dict[int, list[_Boost]] = {}
    for b in boosts.values():
        by_source.setdefault(b.cell.source, []).append(b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, part in batch.groupby("source"):
                x = np.stack(part["x"].to_numpy()).astype(float)
                y, slices = part["y"].to_numpy(), part["slice"].to_numpy()
                old = np.stack(part["v"].to_numpy()) if "v" in part else None
                v = np.zeros((len(part), len(by_source[source])))
                for b in by_source[source]:
                    # A cell that is done is not read again.
                    held = b.cell.holds(slices)
                    if not b.done and len(x[held]):
                        before = None if old is None else old[held][:, b.cell.at]
                        v[held, b.cell.at] = b.logged(x[held], b.cell.local(y[held]), before)
                yield part.assign(v=list(v))

    path = scratch_dir(rows.df.sparkSession, "boost")
    schema = "source int, slice int, x array<double>, y int, v array<double>"
    rows.df.mapInPandas(run, schema).write.parquet(path)
    for b in boosts.values():
        b.written = len(b.stumps)
    return replace(rows, df=rows.df.sparkSession.read.schema(schema).parquet(path))
