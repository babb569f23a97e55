"""Centre and scale numeric features."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwise.frame import Frame, quoted
from foldwise.operators.base import MomentFit, Moments, Projection, check_numeric, named


@dataclass(frozen=True)
class FittedScale(Projection):
    """(mean, divisor) per feature; scaled features go to the end, in order."""

    factors: dict[str, tuple[float, float]]

    def columns(self, frame: Frame) -> dict[str, Column]:
        columns = {n: c for n, c in frame.columns().items() if n not in self.factors}
        for name, (mean, divisor) in self.factors.items():
            columns[name] = F.expr(
                f"(CAST({quoted(name)} AS DOUBLE) - {mean!r}D) / {divisor!r}D")
        return columns


class Scale(MomentFit):
    """Subtract the mean and divide by the population standard deviation.

    Nulls are skipped in the fit and kept in the output; a feature without
    spread is divided by 1.
    """

    def __init__(self, features: list[str] = (), with_mean: bool = True, with_std: bool = True):
        self.features = list(features)
        self.with_mean = with_mean
        self.with_std = with_std

    def names(self, frame: Frame) -> list[str]:
        names = named(frame, self.features)
        check_numeric(frame, names, "scaling")
        return names

    def from_moments(self, frame: Frame, found: dict[str, Moments]) -> FittedScale:
        return FittedScale({n: (m.mean if self.with_mean else 0.0,
                                self._divisor(m) if self.with_std else 1.0)
                            for n, m in found.items()})

    @staticmethod
    def _divisor(m: Moments) -> float:
        eps = sys.float_info.epsilon
        # Rounding noise around a constant is no spread.
        noise = m.n * eps * m.variance + (m.n * m.mean * eps) ** 2
        return math.sqrt(m.variance) if m.variance > noise else 1.0
