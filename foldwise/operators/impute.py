"""Fill missing values from training statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.frame import Frame, col
from foldwise.functions.ordered import exact_medians
from foldwise.operators.base import (Cells, Projection, add_moments, check_numeric, moments,
                                     named, parse_value)
from foldwise.operators.folds import SLICE

STRATEGIES = ("mean", "median", "most_frequent", "constant")


# Fixed value: the prefix of indicator columns that users of such imputers know.
INDICATOR = "missingindicator_"


def present(frame: Frame, name: str, missing) -> Column:
    """The feature with null for values that stand for missing ones."""
    if missing is None:
        return col(name)
    return F.when(~col(name).eqNullSafe(F.lit(missing).cast(frame.type_of(name))), col(name))


@dataclass(frozen=True)
class FittedImpute(Projection):
    """One fill value per feature; features keep their place, indicators follow at the end."""

    fills: dict[str, object]
    as_double: bool
    missing: object = None
    indicators: tuple[str, ...] = ()

    def columns(self, frame: Frame) -> dict[str, Column]:
        columns = frame.columns()
        for name, fill in self.fills.items():
            kind = T.DoubleType() if self.as_double else frame.type_of(name)
            own = present(frame, name, self.missing)
            filled = F.coalesce(own.cast(kind), F.lit(fill).cast(kind))
            if self.missing is not None:
                # Only the stated value is missing; a null stays one.
                filled = F.when(col(name).isNull(), F.lit(None).cast(kind)).otherwise(filled)
            columns[name] = filled
        for name in self.indicators:
            gone = (col(name).isNull() if self.missing is None
                    else F.coalesce(present(frame, name, self.missing).isNull()
                                    & col(name).isNotNull(), F.lit(False)))
            columns[INDICATOR + name] = gone.cast("double")
        return columns


class Impute:
    """Replace nulls by the mean, the exact median, the most frequent value
    (ties: the smallest) or a constant.

    With ``missing_values`` (other than null or NaN) that value is missing, not
    null. ``add_indicator`` adds a 0/1 column for each feature with missing
    values in the training rows, at the end.
    """

    def __init__(self, features: list[str] = (), strategy: str = "mean", fill_value=None,
                 missing_values=None, add_indicator: bool = False):
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
        self.features = list(features)
        self.strategy = strategy
        self.fill_value = fill_value
        # NaN is read as null.
        self.missing = None if missing_values != missing_values else missing_values
        self.add_indicator = add_indicator

    def fit(self, frame: Frame) -> FittedImpute:
        return self._fit(frame, {None: None}, None)[None]

    def fit_cells(self, frame: Frame, cells: Cells, by: str = SLICE) -> dict:
        return self._fit(frame, cells, by)

    def _fit(self, frame: Frame, cells: Cells, by: str | None) -> dict:
        names = named(frame, self.features)
        if self.strategy in ("mean", "median"):
            check_numeric(frame, names, f"the {self.strategy}")
        marked = self._marked(frame, names, cells, by)
        if self.missing is not None:
            columns = {n: present(frame, n, self.missing) if n in names else c
                       for n, c in frame.columns().items()}
            frame = frame.rebuild(columns)
        fit = {"mean": self._means, "median": self._medians,
               "most_frequent": self._modes, "constant": self._constants}[self.strategy]
        fills = fit(frame, names, cells, by)
        for key, found in fills.items():
            empty = [n for n, v in found.items() if v is None]
            if empty:
                raise ValueError(f"nothing to learn a fill value from in {empty} ({key})")
        double = self.strategy in ("mean", "median")
        return {k: FittedImpute(v, double, self.missing, marked[k]) for k, v in fills.items()}

    def _marked(self, frame, names, cells, by) -> dict:
        """The features that get an indicator: those with missing values in the cell."""
        if not self.add_indicator:
            return {k: () for k in cells}
        gone = [F.max((present(frame, n, self.missing).isNull()
                       & (col(n).isNotNull() if self.missing is not None else F.lit(True))).cast("int"))
                .alias(f"m{i}") for i, n in enumerate(names)]
        slot = F.lit(0) if by is None else col(by)
        rows = {r["s"]: r for r in frame.df.groupBy(slot.alias("s")).agg(*gone).collect()}
        return {k: tuple(n for i, n in enumerate(names) if any(
            rows[s][f"m{i}"] for s in (rows if slices is None else slices) if s in rows))
            for k, slices in cells.items()}

    def _means(self, frame, names, cells, by):
        parts = moments(frame, names, by)
        out = {}
        for key, slices in cells.items():
            total = add_moments(parts, names, slices)
            out[key] = {n: m.mean if m.n else None for n, m in total.items()}
        return out

    def _medians(self, frame, names, cells, by):
        masks = None if by is None else {k: col(by).isin(s) for k, s in cells.items()}
        found = exact_medians(frame.df, {n: col(n) for n in names}, masks)
        return {k: {n: found[k, n] for n in names} for k in cells}

    def _modes(self, frame, names, cells, by):
        keys = list(cells)
        slot = F.lit(0) if by is None else col(by)
        long = frame.df.select(slot.alias("s"), F.explode(F.array(*[
            F.struct(F.lit(i).alias("f"), col(n).cast("string").alias("v"))
            for i, n in enumerate(names)])).alias("e")).select("s", "e.f", "e.v")
        tally = long.filter(F.col("v").isNotNull()).groupBy("f", "v").agg(*[
            (F.count(F.lit(1)) if by is None else F.count_if(F.col("s").isin(cells[k])))
            .alias(f"c{j}") for j, k in enumerate(keys)])
        number = F.lit(None).cast("double")
        for i, n in enumerate(names):
            if frame.is_numeric(n):
                number = F.when(F.col("f") == i, F.col("v").try_cast("double")).otherwise(number)
        # The least (-count, value) is the most frequent, smallest value.
        best = tally.groupBy("f").agg(*[
            F.min(F.when(F.col(f"c{j}") > 0, F.struct(-F.col(f"c{j}"), number, F.col("v"))))
            .alias(f"m{j}") for j in range(len(keys))]).collect()
        out = {k: {n: None for n in names} for k in keys}
        for r in best:
            name = names[r["f"]]
            for j, k in enumerate(keys):
                if r[f"m{j}"] is not None:
                    out[k][name] = parse_value(r[f"m{j}"][2], frame.type_of(name))
        return out

    def _constants(self, frame, names, cells, by):
        def fill(n):
            value = self.fill_value
            if value is None:
                if isinstance(frame.type_of(n), T.BooleanType):
                    raise TypeError(f"a constant for the boolean feature {n!r} must be given")
                value = 0 if frame.is_numeric(n) else "missing_value"
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            if frame.is_numeric(n) and not number:
                raise TypeError(f"the constant {value!r} does not fit the number {n!r}")
            if isinstance(frame.type_of(n), T.BooleanType) and not isinstance(value, bool):
                raise TypeError(f"the constant {value!r} does not fit the boolean {n!r}")
            return value
        return {k: {n: fill(n) for n in names} for k in cells}
