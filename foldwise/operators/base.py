"""What a transform is.

A plain transform has ``apply(frame) -> frame``. A fitted transform has
``fit(frame)``, which returns an immutable object with such an ``apply``: fit
is an aggregation over the training rows, apply is a projection. Any user
object with one of these two methods can stand in a pipeline.

A transform whose statistics can be grouped also has ``fit_cells``: they are
gathered once per value of a key (the slice by default), in one job, and added
up for each cell (a set of values), so a hundred folds cost one pass.
"""

from __future__ import annotations

from collections.abc import Hashable
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.frame import Frame, col
from foldwise.operators.folds import SLICE

Cells = dict[Hashable, list[int]]
CELL = "cell"


class Projection:
    """A fitted transform that gives each output feature as an expression."""

    # Whether ``columns`` needs nothing but the frame; else only ``apply`` serves.
    plain = True

    def columns(self, frame: Frame) -> dict[str, Column]:
        raise NotImplementedError

    def apply(self, frame: Frame) -> Frame:
        return frame.rebuild(self.columns(frame))


def expand(frame: Frame, cells: Cells) -> Frame:
    """Every row once per cell that trains on it; the key ``cell`` numbers them.

    Rows multiply inside a task only: what follows is an aggregation per cell
    with map-side combine.
    """
    members: dict[int, list[int]] = {}
    for i, slices in enumerate(cells.values()):
        for s in slices:
            members.setdefault(s, []).append(i)
    pairs = [x for s, own in members.items()
             for x in (F.lit(s), F.array(*[F.lit(i) for i in own]))]
    mine = F.try_element_at(F.create_map(*pairs), col(SLICE))
    df = frame.df.withColumn(CELL, F.explode(mine))
    return replace(frame, df=df, keys=(*frame.keys, CELL))


def apply_cells(fitted: dict[int, Projection], frame: Frame, cell: Column) -> Frame | None:
    """Transform each row by the fit of its cell, in one projection.

    None if the fits do not give the same features, e.g. other categories.
    """
    parts = {k: f.columns(frame) for k, f in fitted.items()}
    first = next(iter(parts.values()))
    if any(list(p) != list(first) for p in parts.values()):
        return None
    out = {}
    for name in first:
        chosen = None
        for k, p in parts.items():
            chosen = (F if chosen is None else chosen).when(cell == F.lit(k), p[name])
        out[name] = chosen
    return frame.rebuild(out)


def named(frame: Frame, features: list[str]) -> list[str]:
    """The requested features, or all of them if none are named."""
    return frame.require(features) if features else list(frame.features)


def check_numeric(frame: Frame, names: list[str], what: str) -> None:
    text = [n for n in names if not frame.is_numeric(n)]
    if text:
        raise TypeError(f"{what} needs numeric features, not {text}")


@dataclass(frozen=True)
class Moments:
    """Count, mean and sum of squared deviations; addable."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        if n == 0:
            return Moments()
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * other.n / n,
                       self.m2 + other.m2 + gap * gap * self.n * other.n / n)

    @property
    def variance(self) -> float:
        return self.m2 / self.n if self.n else 0.0


def _slot(by: str | None) -> Column:
    return (F.lit(0) if by is None else col(by)).alias("s")


def moments(frame: Frame, names: list[str], by: str | None) -> dict[int, dict[str, Moments]]:
    """Moments of each feature per value of a key (under 0 without one)."""
    rows = frame.df.groupBy(_slot(by)).agg(*[
        f(col(n).cast("double")).alias(f"{tag}{i}") for i, n in enumerate(names)
        for tag, f in (("n", F.count), ("a", F.avg), ("v", F.var_pop))]).collect()
    return {r["s"]: {n: Moments(r[f"n{i}"], r[f"a{i}"] or 0.0,
                                (r[f"v{i}"] or 0.0) * r[f"n{i}"])
                     for i, n in enumerate(names)} for r in rows}


def add_moments(parts: dict[int, dict[str, Moments]], names: list[str],
                slices: list[int] | None = None) -> dict[str, Moments]:
    picked = parts if slices is None else [s for s in slices if s in parts]
    return {n: sum((parts[s][n] for s in picked), Moments()) for n in names}


@dataclass(frozen=True)
class ValueCounts:
    """Rows per value of one feature, nulls apart; values in sorted order."""

    values: tuple
    counts: tuple[int, ...]
    nulls: int
    rows: int


def value_counts(frame: Frame, names: list[str], by: str | None, most: int
                 ) -> dict[int, dict[str, dict[object, int]]]:
    """Rows per value and feature, per value of a key; null is a value here.

    For features whose every value becomes a column: ``most`` is how many there
    may be, more are an error.
    """
    if not names:
        return {}
    long = frame.df.select(_slot(by), F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), col(n).cast("string").alias("v"))
        for i, n in enumerate(names)])).alias("e")).select("s", "e.f", "e.v")
    found = (long.groupBy("s", "f", "v").count().groupBy("f", "v")
             .agg(F.collect_list(F.struct("s", "count")).alias("parts"))
             .limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"one-hot encoding would make more than {most} columns of {names}; set "
                         f"max_categories, or a larger max_columns")
    out: dict[int, dict[str, dict[object, int]]] = {}
    for r in found:
        name = names[r["f"]]
        value = parse_value(r["v"], frame.type_of(name))
        for part in r["parts"]:
            out.setdefault(part["s"], {n: {} for n in names})[name][value] = part["count"]
    return out


def add_counts(parts: dict[int, dict[str, dict[object, int]]], names: list[str],
               slices: list[int] | None = None) -> dict[str, ValueCounts]:
    picked = list(parts) if slices is None else [s for s in slices if s in parts]
    out = {}
    for n in names:
        total: dict[object, int] = {}
        for s in picked:
            for value, k in parts[s][n].items():
                total[value] = total.get(value, 0) + k
        nulls = total.pop(None, 0)
        ordered = sorted(total)
        out[n] = ValueCounts(tuple(ordered), tuple(total[v] for v in ordered), nulls,
                             nulls + sum(total.values()))
    return out


def parse_value(text: str | None, kind: T.DataType):
    """Undo a cast to string."""
    if text is None:
        return None
    if isinstance(kind, T.IntegralType):
        return int(text)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(text)
    if isinstance(kind, T.DecimalType):
        return Decimal(text)
    if isinstance(kind, T.BooleanType):
        return text == "true"
    return text


def typed(value, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind)


class MomentFit:
    """Fit from moments, for one frame or for many cells in one job."""

    def fit(self, frame: Frame):
        names = self.names(frame)
        parts = moments(frame, names, by=None)
        return self.from_moments(frame, add_moments(parts, names))

    def fit_cells(self, frame: Frame, cells: Cells, by: str = SLICE):
        names = self.names(frame)
        parts = moments(frame, names, by=by)
        return {k: self.from_moments(frame, add_moments(parts, names, s))
                for k, s in cells.items()}
