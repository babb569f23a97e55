"""Tunable parameters: a search space and seeded samples from it as columns.

A parameter spec is a dict: ``{"type": "float", "low", "high", "step", "log"}``,
``int`` with the same keys, ``{"type": "categorical", "choices"}`` or
``{"type": "constant", "value"}``; an optional ``label`` names its column.
Anything that is not a dict is a fixed value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.frame import col
from foldwise.functions.hashing import uniform

TYPES = ("float", "int", "categorical", "constant")


@dataclass(frozen=True)
class Parameter:
    """One tunable value. Categories are stored as text, numbers as numbers."""

    label: str
    kind: str
    low: float = 0.0
    high: float = 0.0
    step: float | None = None
    log: bool = False
    choices: tuple = ()

    @staticmethod
    def of(label: str, spec: dict) -> "Parameter":
        kind = spec.get("type")
        label = spec.get("label") or label
        if kind not in TYPES:
            raise ValueError(f"parameter {label!r} has invalid type {kind!r}; use one of {TYPES}")
        if kind in ("categorical", "constant"):
            choices = spec["choices"] if kind == "categorical" else [spec["value"]]
            if not choices:
                raise ValueError(f"parameter {label!r} has no choices")
            return Parameter(label, "categorical", choices=tuple(choices))
        low, high = spec["low"], spec["high"]
        step, log = spec.get("step"), bool(spec.get("log", False))
        if low > high or (log and low <= 0):
            raise ValueError(f"parameter {label!r} has an empty range")
        if log and step not in (None, 1):
            raise ValueError(f"parameter {label!r} cannot have both log and step")
        if kind == "int":
            step = None if log else int(step or 1)
        return Parameter(label, kind, low, high, step, log)

    @property
    def sql_type(self) -> str:
        return {"float": "double", "int": "bigint", "categorical": "string"}[self.kind]

    def first(self):
        """Some value of the range: the first choice, or the low end."""
        return self.choices[0] if self.kind == "categorical" else self.low

    def draw(self, u: Column) -> Column:
        """The value for a uniform number in [0, 1)."""
        if self.kind == "categorical":
            texts = F.array(*[F.lit(text(c)).cast("string") for c in self.choices])
            return F.element_at(texts, F.floor(u * len(self.choices)).cast("int") + 1)
        low, high = float(self.low), float(self.high)
        if self.kind == "int" and self.log:
            return self.settle(F.exp(F.lit(math.log(low - 0.5)) + u * F.lit(
                math.log(high + 0.5) - math.log(low - 0.5))))
        if self.log:
            return F.exp(F.lit(math.log(low)) + u * F.lit(math.log(high) - math.log(low)))
        if self.step:
            steps = math.floor((high - low) / self.step + 1e-9) + 1
            value = F.lit(low) + F.floor(u * steps) * F.lit(float(self.step))
            return value.cast(self.sql_type)
        return F.lit(low) + u * F.lit(high - low)

    def settle(self, value: Column) -> Column:
        """Bring a free number onto the grid and into the range."""
        low, high = F.lit(float(self.low)), F.lit(float(self.high))
        if self.step:
            value = low + F.round((value - low) / self.step) * F.lit(float(self.step))
        elif self.kind == "int":
            value = F.round(value)
        value = F.least(F.greatest(value, low), high)
        return value.cast(self.sql_type)

    def decode(self, stored):
        """The Python value behind a stored one."""
        if self.kind != "categorical":
            return stored
        return {text(c): c for c in self.choices}[stored]


def text(choice) -> str | None:
    if choice is None:
        return None
    return str(choice).lower() if isinstance(choice, bool) else str(choice)


@dataclass(frozen=True)
class Space:
    """All tunable parameters of a study, in order, by unique name.

    A name is ``owner.key`` unless the spec gives a label. Two owners with the
    same label are told apart by prefixing the owner.
    """

    parameters: dict[tuple[str, str], Parameter]

    @staticmethod
    def of(owners: dict[str, dict]) -> "Space":
        found: dict[tuple[str, str], Parameter] = {}
        taken: set[str] = set()
        for owner, spec in owners.items():
            for key, value in spec.items():
                if not isinstance(value, dict):
                    continue
                p = Parameter.of(key, value)
                if p.label in taken:
                    p = Parameter(f"{owner}.{p.label}", p.kind, p.low, p.high, p.step, p.log,
                                  p.choices)
                taken.add(p.label)
                found[(owner, key)] = p
        return Space(found)

    def sample(self, trials: DataFrame, seed: int, replicate: str = "replicate",
               trial: str = "trial") -> DataFrame:
        """One value per parameter for each (replicate, trial) row."""
        return trials.select("*", *[
            p.draw(uniform(seed, col(replicate), col(trial), F.lit(p.label))).alias(p.label)
            for p in self.parameters.values()])

    def resolve(self, owner: str, spec: dict, row: dict) -> dict:
        """The spec with its tunable entries replaced by a trial's values."""
        return {k: self.parameters[(owner, k)].decode(row[self.parameters[(owner, k)].label])
                if isinstance(v, dict) else v for k, v in spec.items()}
