"""An ordered list of transforms, gated by level, fitted without leakage.

Levels: ``replicate`` is the split into in-group and out-group, ``cross`` the
split inside the in-group. A transform with ``run_per_replicate`` (default
true) is fitted at the first, one with ``run_per_cross`` (default false) at the
second, with both at both. The flags mean the same for transforms listed before
and after the split; the former see all rows of their level.
"""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable, Hashable
from dataclasses import dataclass

from pyspark.sql import functions as F

from foldwise.frame import Frame
from foldwise.operators import encode, impute, reduce, scale, select
from foldwise.operators.base import CELL, Projection, apply_cells, expand
from foldwise.operators.folds import side
from foldwise.sources.tables import Dump

# The names a data spec uses.
TRANSFORMS: dict[str, Callable] = {
    "drop_features_explicit": select.DropFeatures,
    "keep_features_explicit": select.KeepFeatures,
    "sample_drop_null": select.DropSparseRows,
    "feature_drop_null": select.DropSparseFeatures,
    "imputation_simple": impute.Impute,
    "standard_scaling": scale.Scale,
    "one_hot_encode": encode.OneHot,
    "ordinal_encode": encode.Ordinal,
    "ladder_encode": encode.Ladder,
    "principal_component_analysis": reduce.PrincipalComponents,
    "recursive_feature_elimination": reduce.RecursiveElimination,
    "dump": Dump,
}
GATES = ("run_per_replicate", "run_per_cross")


def is_fitted(kind: Callable) -> bool:
    return hasattr(kind, "fit")


def check_options(kind: Callable, options: dict, name: str) -> None:
    """Raise on options the constructor does not know, before any job runs."""
    accepted = inspect.signature(kind).parameters
    if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in accepted.values()):
        return
    unknown = [k for k in options if k not in accepted]
    if unknown:
        raise ValueError(f"{name!r} has no options {unknown}")


@dataclass(frozen=True)
class Step:
    """One entry of a data spec; ``options`` may hold tunable parameters."""

    name: str
    owner: str
    kind: Callable
    options: dict
    per_replicate: bool = True
    per_cross: bool = False

    @staticmethod
    def of(place: int, spec: dict, custom: dict[str, Callable]) -> "Step":
        spec = dict(spec)
        name = spec.pop("type")
        kind = {**TRANSFORMS, **custom}.get(name)
        if kind is None:
            raise ValueError(f"unknown transform {name!r}")
        gates = [spec.pop(g, default) for g, default in zip(GATES, (True, False))]
        if not all(isinstance(g, bool) for g in gates):
            raise TypeError(f"{GATES} must be booleans")
        check_options(kind, spec, name)
        tunable = getattr(kind, "tunable", ())
        bad = [k for k, v in spec.items() if isinstance(v, dict) and k not in tunable]
        if bad:
            raise ValueError(f"{name!r} cannot tune {bad}")
        return Step(name, f"{place}_{name}", kind, spec, *gates)

    def build(self, options: dict):
        return self.kind(**options)

    @property
    def tuned(self) -> bool:
        return any(isinstance(v, dict) for v in self.options.values())

    def runs_at(self, level: str) -> bool:
        return self.per_replicate if level == "replicate" else self.per_cross


@dataclass(frozen=True)
class Pipeline:
    """Steps before and after the split."""

    before: tuple[Step, ...] = ()
    after: tuple[Step, ...] = ()

    @staticmethod
    def of(spec: dict, custom: dict[str, Callable] | None = None) -> "Pipeline":
        """From the ``pre_split_hooks`` and ``post_split_hooks`` of a data spec."""
        before = [Step.of(i, s, custom or {}) for i, s in enumerate(spec.get("pre_split_hooks", []))]
        after = [Step.of(len(before) + i, s, custom or {})
                 for i, s in enumerate(spec.get("post_split_hooks", []))]
        for step in before:
            if is_fitted(step.kind):
                warnings.warn(f"{step.name!r} before the split learns from held-out rows",
                              stacklevel=2)
        for step in after:
            if not is_fitted(step.kind):
                warnings.warn(f"{step.name!r} is not fitted, yet runs after the split",
                              stacklevel=2)
        for step in (*before, *after):
            if not step.tuned:
                step.build(step.options)  # fail on bad options before any job
        return Pipeline(tuple(before), tuple(after))

    def owners(self) -> dict[str, dict]:
        """Options by owner, for the search space."""
        return {s.owner: s.options for s in (*self.before, *self.after)}

    @property
    def fixed(self) -> int:
        """How many leading steps before the split no trial and no replicate changes."""
        return next((i for i, s in enumerate(self.before) if s.per_replicate and s.tuned),
                    len(self.before))

    def prepare(self, frame: Frame, level: str, run: "Run", steps: slice = slice(None)) -> Frame:
        """Apply the steps listed before the split to all rows of the level."""
        for step in self.before[steps]:
            if step.runs_at(level):
                frame = run.whole(step, frame, level)
        return frame

    def split(self, train: Frame, test: Frame, level: str, run: "Run") -> tuple[Frame, Frame]:
        """Fit the later steps on train, apply them to both sides."""
        for step in self.after:
            if step.runs_at(level):
                train, test = run.sides(step, train, test, level)
        return train, test

    def fit_ahead(self, frame: Frame, level: str, runs: dict["Run", list[int]]) -> None:
        """Fit the leading later steps of a level for all its cells, a job a step.

        The first step reads the same rows in every cell: its statistics are
        gathered per slice and added up. For the next ones each row is taken
        once per cell that trains on it, transformed by that cell's fits so
        far, and aggregated per cell. Stops at a step that cannot be grouped.
        """
        long = None
        for step in (s for s in self.after if s.runs_at(level)):
            if step.tuned and not all(run.private for run in runs):
                return
            built = step.build(next(iter(runs)).resolve(step))
            if not hasattr(built, "fit_cells"):
                return
            if all(run.key(step, level) in run.fits for run in runs):
                fitted = {i: run.fits[run.key(step, level)] for i, run in enumerate(runs)}
            elif long is None:
                fitted = built.fit_cells(frame, dict(enumerate(runs.values())))
            else:
                fitted = built.fit_cells(long, {i: [i] for i in range(len(runs))}, by=CELL)
            for i, run in enumerate(runs):
                run.fits[run.key(step, level)] = fitted[i]
            if long is None:
                long = expand(frame, runs)
            if not all(isinstance(f, Projection) and f.plain for f in fitted.values()):
                return
            long = apply_cells(fitted, long, F.col(CELL))
            if long is None:
                return


class Run:
    """Fits of one cell: resolves tuned options and reuses earlier fits.

    ``fits`` may be shared by all trials of a study: a fit depends on nothing a
    trial tunes until the first tuned step, and only up to there it is used. A
    ``private`` store belongs to one trial and serves throughout.
    """

    def __init__(self, cell: Hashable, resolve: Callable[[Step], dict], fits: dict,
                 private: bool = False):
        self.cell, self.resolve, self.fits, self.private = cell, resolve, fits, private
        self.clean = True

    def key(self, step: Step, level: str) -> tuple:
        return (self.cell, level, step.owner)

    def _fitted(self, step: Step, frame: Frame, level: str):
        built = step.build(self.resolve(step))
        self.clean = self.clean and not step.tuned
        if not is_fitted(step.kind):
            return built
        key = self.key(step, level)
        usable = self.clean or self.private
        if usable and key in self.fits:
            return self.fits[key]
        fitted = built.fit(frame)
        if usable:
            self.fits[key] = fitted
        return fitted

    def whole(self, step: Step, frame: Frame, level: str) -> Frame:
        return self._apply(self._fitted(step, frame, level), frame, level)

    def sides(self, step: Step, train: Frame, test: Frame, level: str) -> tuple[Frame, Frame]:
        fitted = self._fitted(step, train, level)
        return (self._apply(fitted, train, f"{level}-train"),
                self._apply(fitted, test, f"{level}-test"))

    def _apply(self, fitted, frame: Frame, stage: str) -> Frame:
        if isinstance(fitted, Dump):
            return fitted.apply(frame, f"{self.cell}-{stage}")
        return fitted.apply(frame)


def fit_cells(step, frame: Frame, cells: dict[Hashable, list[int]]) -> dict:
    """Fit one transform for many train sides; in one job if it can be."""
    if hasattr(step, "fit_cells"):
        return step.fit_cells(frame, cells)
    return {k: step.fit(side(frame, s)) for k, s in cells.items()}
