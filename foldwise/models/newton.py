"""Logistic regressions of many cells at once, by proximal Newton steps.

Every step is one job for all cells that are not done: each task sums loss,
gradient and Hessian of every cell over its rows. The driver solves each cell's
small quadratic problem, with l1 by coordinate descent, and halves a step whose
objective did not fall. The objective is that of ``LogisticClassifier``:

    sum(loss) + (share * sum|w| + (1 - share) / 2 * sum(w^2)) / C

Two classes have one vector of weights, more have one each (softmax);
intercepts are not penalised.
"""

from __future__ import annotations

from collections.abc import Hashable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.frame import Frame
from foldwise.functions.vectors import feature_array
from foldwise.models.base import as_trained, predictions
from foldwise.models.cells import Cell, CellRows, summed, waves

# A cell is done when its steps promise less than this share of its objective.
TOLERANCE = 1e-9
RIDGE = 1e-9


@dataclass(frozen=True)
class FittedLogistic:
    """Weights by class, intercept last; one row for two classes."""

    weights: np.ndarray
    classes: tuple
    features: tuple[str, ...]

    def predict(self, frame: Frame) -> DataFrame:
        frame = as_trained(frame, self.features)
        df = frame.df.withColumn("__x", feature_array(frame))
        margins = [_margin(F.col("__x"), w) for w in self.weights]
        if len(margins) == 1:
            margins = [F.lit(0.0), *margins]
        df = df.withColumn("__m", F.array(*margins))
        # Shifted by the largest, so that no exponential overflows.
        df = df.withColumn("__e", F.transform("__m", lambda m: F.exp(m - F.array_max("__m"))))
        total = F.aggregate("__e", F.lit(0.0), lambda a, b: a + b)
        return predictions(df, frame.keys, self.classes, F.transform("__e", lambda e: e / total))


def _margin(x: Column, weights: np.ndarray) -> Column:
    known = F.array(*[F.lit(float(w)) for w in weights[:-1]])
    return F.aggregate(F.zip_with(x, known, lambda a, b: a * b), F.lit(float(weights[-1])),
                       lambda a, b: a + b)


def probabilities(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each class, probability of each class with own weights)."""
    margins = x @ weights[:, :-1].T + weights[:, -1]
    if len(weights) == 1:
        margins = np.hstack([np.zeros((len(x), 1)), margins])
    top = margins.max(axis=1, keepdims=True)
    logged = margins - top - np.log(np.exp(margins - top).sum(axis=1, keepdims=True))
    return logged, np.exp(logged[:, -len(weights):])


def sums_of(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of some rows in one array."""
    k, width = weights.shape
    logged, p = probabilities(x, weights)
    loss = -logged[np.arange(len(y)), y].sum()
    # The first class of two has no weights of its own.
    first = logged.shape[1] - k
    hit = (y[:, None] - first == np.arange(k)).astype(float)
    wide = np.hstack([x, np.ones((len(x), 1))])
    gradient = (p - hit).T @ wide
    hessian = np.zeros((k, width, k, width))
    for a in range(k):
        for b in range(a, k):
            share = p[:, a] * ((a == b) - p[:, b])
            block = wide.T @ (wide * share[:, None])
            hessian[a, :, b], hessian[b, :, a] = block, block
    return np.concatenate([[loss], gradient.ravel(), hessian.ravel()])


def _soft(value: float, by: float) -> float:
    return max(value - by, 0.0) + min(value + by, 0.0)


@dataclass
class _State:
    """A cell's weights on its way to the minimum."""

    weights: np.ndarray
    l1: np.ndarray
    l2: np.ndarray
    step: np.ndarray | None = None
    scale: float = 1.0
    value: float = np.inf
    promised: float = 0.0
    steps: int = 0
    done: bool = False
    # At the weights, with the penalty.
    hessian: np.ndarray | None = None

    @property
    def point(self) -> np.ndarray:
        return self.weights if self.step is None else self.weights + self.scale * self.step

    def objective(self, loss: float, w: np.ndarray) -> float:
        return loss + (self.l1 * np.abs(w)).sum() + 0.5 * (self.l2 * w * w).sum()

    def take(self, sums: np.ndarray) -> None:
        """Accept or halve the last step, then find the next one."""
        at = self.point
        value = self.objective(sums[0], at)
        if self.step is not None and value > self.value + 1e-4 * self.scale * self.promised:
            self.scale /= 2
            self.done = self.scale < 1e-8
            return
        fallen = self.value - value
        self.weights, self.value, self.steps = at, value, self.steps + 1
        size = at.size
        gradient = sums[1:1 + size] + (self.l2 * at).ravel()
        hessian = sums[1 + size:].reshape(size, size) + np.diag(self.l2.ravel())
        hessian += RIDGE * max(1.0, np.trace(hessian) / size) * np.eye(size)
        self.hessian = hessian
        step = _solve(gradient, hessian, at.ravel(), self.l1.ravel())
        moved = at.ravel() + step
        self.promised = gradient @ step + (self.l1.ravel() * (np.abs(moved) - np.abs(at.ravel()))).sum()
        self.step, self.scale = step.reshape(at.shape), 1.0
        small = TOLERANCE * max(1.0, abs(value))
        if -self.promised <= small or (np.isfinite(fallen) and 0 <= fallen <= small):
            # The last step promises next to nothing in value, but sharpens the weights.
            self.weights, self.done = at + self.step, True


def _solve(gradient: np.ndarray, hessian: np.ndarray, at: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The step to the minimum of the quadratic model plus l1 * |w|."""
    step = np.linalg.lstsq(hessian, -gradient, rcond=None)[0] if not l1.any() else np.zeros_like(at)
    if not l1.any():
        return step
    slope = gradient.copy()
    for _ in range(1000):
        largest = 0.0
        for j in range(len(at)):
            h = hessian[j, j]
            now = at[j] + step[j]
            target = _soft(now - slope[j] / h, l1[j] / h)
            change = target - now
            if change:
                step[j] += change
                slope += hessian[:, j] * change
                largest = max(largest, abs(change) * np.sqrt(h))
        if largest < 1e-10:
            break
    return step


def numbers(cell: Cell) -> int:
    """How many numbers a cell sends to the driver in a step."""
    return ((1 if len(cell.classes) == 2 else len(cell.classes)) * (len(cell.features) + 1) + 1) ** 2


def fit(rows: CellRows, strengths: dict[Hashable, tuple[float | None, float]],
        max_iter: int = 100) -> dict[Hashable, FittedLogistic]:
    """Weights of every cell, given its (C, share of l1); C None means no penalty."""
    states = {key: _start(rows.cells[key], *strengths[key]) for key in strengths}
    for wave in waves(list(states), lambda key: numbers(rows.cells[key])):
        for _ in range(max_iter):
            active = [k for k in wave if not states[k].done]
            if not active:
                break
            points = {k: states[k].point for k in active}

            def work(key, cell, x, y, v, points=points):
                return sums_of(x, y, points[key])

            for key, sums in summed(rows, active, work).items():
                states[key].take(sums)
    return {key: FittedLogistic(s.weights, rows.cells[key].classes, rows.cells[key].features)
            for key, s in states.items()}


def eliminate(rows: CellRows, key: Hashable, strength: tuple[float | None, float], keep: int,
              max_iter: int = 100) -> list[int]:
    """Places of the features left when the weakest goes, one after the other, until ``keep``
    are left; weakest is the smallest sum over classes of squared weights.

    Each fit starts where the last one's quadratic model has its minimum without the
    feature, which is a step or two from its own.
    """
    cell = rows.cells[key]
    state, left = _start(cell, *strength), list(range(len(cell.features)))
    while len(left) > keep:
        for _ in range(max_iter):
            if state.done:
                break
            point, own = state.point, list(left)

            def work(key, cell, x, y, v, point=point, own=own):
                return sums_of(x[:, own], y, point)

            state.take(summed(rows, [key], work)[key])
        weakest = int(np.argmin(np.square(state.weights[:, :-1]).sum(axis=0)))
        state = _without(state, weakest)
        left.pop(weakest)
    return left


def _without(state: _State, feature: int) -> _State:
    """The start of the fit without a feature."""
    gone = np.zeros(state.weights.shape, dtype=bool)
    gone[:, feature] = True
    out, rest = gone.ravel(), ~gone.ravel()
    # What the others gain when its weights go to 0, by the quadratic model.
    change = np.linalg.solve(state.hessian[np.ix_(rest, rest)],
                             state.hessian[np.ix_(rest, out)] @ state.weights.ravel()[out])
    shape = (len(state.weights), -1)
    return _State((state.weights.ravel()[rest] + change).reshape(shape),
                  state.l1[~gone].reshape(shape), state.l2[~gone].reshape(shape))


def _start(cell: Cell, c: float | None, share: float) -> _State:
    """Zero weights, and intercepts that give the classes their frequencies."""
    k = 1 if len(cell.classes) == 2 else len(cell.classes)
    weights = np.zeros((k, len(cell.features) + 1))
    logged = np.log(cell.counts)
    weights[:, -1] = logged[1] - logged[0] if k == 1 else logged - logged.mean()
    penalised = np.ones_like(weights)
    penalised[:, -1] = 0.0
    strength = 0.0 if c is None else 1.0 / c
    return _State(weights, strength * share * penalised, strength * (1 - share) * penalised)
