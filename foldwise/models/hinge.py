"""Linear machines on a feature map, by passes that never keep the map's outputs.

Training rows are packed into blocks of numbers and kept; a pass maps them block
by block, as much as fits a task. The mean hinge loss plus ``strength`` / 2 *
|w|^2 is minimised by limited-memory BFGS on the driver, over outputs of mean 0
and deviation 1. A pass tells loss and gradient at several steps along a
direction, of all machines, so it needs no line search of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.vectors import VECTOR
from foldwise.models.base import INDEX
from foldwise.models.cells import waves

# Numbers that a task maps in a pass.
TASK_NUMBERS = 2**23
MEMORY = 10
# A machine is done when it gained less than this share of its first loss in so many steps.
TOLERANCE, STEPS_BACK = 1e-3, 10
FIRST = tuple(4.0**k for k in range(3, -5, -1))
STEPS = (2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y): the features and classes of a batch, as bytes."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()),
                                              pa.array([y.tobytes()], pa.binary())], names=["x", "y"])


@dataclass
class _Descent:
    """One machine on its way to the minimum."""

    at: np.ndarray
    value: float = math.inf
    gradient: np.ndarray | None = None
    pairs: list = field(default_factory=list)
    values: list = field(default_factory=list)
    points: list = field(default_factory=list)
    done: bool = False

    def propose(self) -> list[np.ndarray]:
        """Where loss and gradient are asked for next."""
        if self.gradient is None:
            self.points = [self.at]
        else:
            direction, steps = self._direction(), STEPS if self.pairs else FIRST
            self.points = [self.at + t * direction for t in steps]
        return self.points

    def _direction(self) -> np.ndarray:
        q, used = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1e-300, np.linalg.norm(q))
        for (s, y), a in zip(self.pairs, reversed(used)):
            q += (a - (y @ q) / (s @ y)) * s
        return -q

    def take(self, values: np.ndarray, gradients: np.ndarray) -> None:
        best = int(np.argmin(values))
        if self.gradient is not None and values[best] >= self.value:
            # No step helps: once more along the gradient, then it is over.
            self.done, self.pairs = not self.pairs, []
            return
        point, gradient = self.points[best], gradients[best]
        if self.gradient is not None:
            s, y = point - self.at, gradient - self.gradient
            if s @ y > 1e-10 * (y @ y):
                self.pairs = [*self.pairs[1 - MEMORY:], (s, y)]
        self.at, self.value, self.gradient = point, float(values[best]), gradient
        self.values.append(self.value)
        early = self.values[-1 - STEPS_BACK] if len(self.values) > STEPS_BACK else math.inf
        self.done = (early - self.value <= TOLERANCE * abs(self.values[0])
                     or np.linalg.norm(gradient) <= 1e-8)


def fit(rows: DataFrame, n: int, feature_map, class_weights: list[float], targets: list[int],
        strength: float, max_iter: int) -> np.ndarray:
    """Weights of a machine for each target class against the rest, intercept last."""
    parts = max(1, math.ceil(n * feature_map.outputs / TASK_NUMBERS))
    blocks = (rows.select(vector_to_array(VECTOR).alias("x"), F.col(INDEX).cast("int").alias("y"))
              .repartition(parts).mapInArrow(_packed, "x binary, y binary")
              .persist(StorageLevel.MEMORY_AND_DISK))
    weight_of, total = np.array(class_weights), None
    try:
        width = feature_map.outputs

        def moments(z: np.ndarray, y: np.ndarray) -> np.ndarray:
            w = weight_of[y]
            return np.concatenate([[[w.sum(), *(w @ z), *(w @ (z * z))]]])

        sums = _summed(blocks, feature_map, moments)[0]
        total = sums[0]
        mean = sums[1:1 + width] / total
        scale = np.sqrt(np.maximum(sums[1 + width:] / total - mean * mean, 0.0))
        scale[scale <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0

        def plain(u: np.ndarray) -> np.ndarray:
            """Weights of the outputs as they are."""
            w = u[:-1] / scale
            return np.append(w, u[-1] - mean @ w)

        machines = [_Descent(np.zeros(width + 1)) for _ in targets]
        for wave in waves(list(range(len(targets))), lambda i: len(STEPS) * (width + 2)):
            for _ in range(max_iter + 1):
                active = [i for i in wave if not machines[i].done]
                if not active:
                    break
                points = [(i, plain(u)) for i in active for u in machines[i].propose()]
                weights = np.array([w for _, w in points])
                own = np.array([targets[i] for i, _ in points])

                def losses(z: np.ndarray, y: np.ndarray, weights=weights, own=own) -> np.ndarray:
                    side = np.where(y[:, None] == own, 1.0, -1.0)
                    short = 1.0 - side * (z @ weights[:, :-1].T + weights[:, -1])
                    w = weight_of[y][:, None]
                    slope = np.where(short > 0, -side * w, 0.0)
                    return np.hstack([(np.maximum(short, 0.0) * w).sum(axis=0)[:, None],
                                      slope.T @ z, slope.sum(axis=0)[:, None]])

                found = _summed(blocks, feature_map, losses)
                for i in active:
                    at = [j for j, (k, _) in enumerate(points) if k == i]
                    w = weights[at][:, :-1]
                    values = found[at, 0] / total + 0.5 * strength * (w * w).sum(axis=1)
                    ends = found[at, -1:]
                    slopes = ((found[at, 1:-1] - ends * mean) / total + strength * w) / scale
                    machines[i].take(values, np.hstack([slopes, ends / total]))
    finally:
        blocks.unpersist()
    return np.array([plain(m.at) for m in machines])


def _summed(blocks: DataFrame, feature_map, work) -> np.ndarray:
    """The sum of ``work(z, y)``, a matrix, over the mapped rows, in one job."""
    step, features = feature_map.at_once(), feature_map.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                y = np.frombuffer(y.as_buffer(), np.int32)
                x = np.frombuffer(x.as_buffer(), float).reshape(len(y), features)
                for i in range(0, len(y), step):
                    part = work(feature_map.of(x[i:i + step]), y[i:i + step])
                    sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(list(sums))],
                names=["at", "sums"])

    partial = blocks.mapInArrow(run, "at int, sums array<double>")
    found = partial.groupBy("at").agg(
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()
    return np.array([r["sums"] for r in sorted(found, key=lambda r: r["at"])])
