"""Choosing columns and rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.frame import Frame, col


def select_features(frame: Frame, names: list[str]) -> Frame:
    """Keep the named features, in the order given."""
    return frame.rebuild({n: col(n) for n in frame.require(names)})


def set_features(frame: Frame, values: dict[str, Column]) -> Frame:
    """Overwrite features in place; new ones go to the end."""
    columns = frame.columns()
    columns.update(values)
    return frame.rebuild(columns)


def drop_features(frame: Frame, names: list[str]) -> Frame:
    """Drop the named features; an unknown name is an error."""
    gone = set(frame.require(names))
    return frame.rebuild({n: col(n) for n in frame.features if n not in gone})


def select_rows(frame: Frame, ids: DataFrame, id_column: str | None = None) -> Frame:
    """Keep the rows whose id occurs in ``ids``.

    Ids are made distinct first: that is combined before the shuffle, so an id
    that occurs very often does not load one task.
    """
    id_column = id_column or ids.columns[0]
    wanted = ids.select(col(id_column).alias(frame.row_id)).distinct()
    return frame.with_df(frame.df.join(wanted, frame.row_id, "left_semi"))


def isolate_target(frame: Frame, target: str) -> Frame:
    """Move one feature to the label role, so that no transform sees it.

    It is called ``label`` from then on, unless another feature is.
    """
    if not target:
        raise ValueError("a target is required: unsupervised runs are not supported")
    if frame.n_features == 1:
        raise TypeError("cannot isolate the target: the table has a single feature")
    frame.require([target])
    features = tuple(n for n in frame.features if n != target)
    label = target if "label" in features else "label"
    df = frame.df.select(*[col(k) for k in frame.keys], col(target).alias(label),
                         *[col(n) for n in features])
    return replace(frame, df=df, features=features, keys=(*frame.keys, label), label=label)


def is_missing(frame: Frame, name: str) -> Column:
    """Null, or NaN in a floating-point feature."""
    missing = col(name).isNull()
    if isinstance(frame.type_of(name), (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(col(name))
    return missing


def nan_to_null(frame: Frame) -> Frame:
    """Read NaN as missing, once, so that later operators test for null only."""
    floats = (T.DoubleType, T.FloatType)
    if not any(isinstance(frame.type_of(n), floats) for n in frame.features):
        return frame
    return frame.rebuild({
        n: F.when(~F.isnan(col(n)), col(n)) if isinstance(frame.type_of(n), floats) else col(n)
        for n in frame.features})


class _Explicit:
    def __init__(self, features: list[str]):
        if not isinstance(features, (list, tuple)):
            raise TypeError("features must be a list of names")
        self.features = list(features)

    @staticmethod
    def check(frame: Frame) -> None:
        if frame.n_features == 1:
            raise TypeError("the table has a single feature; refused to select from it")


class DropFeatures(_Explicit):
    """Drop the listed features."""

    def apply(self, frame: Frame) -> Frame:
        self.check(frame)
        return drop_features(frame, self.features)


class KeepFeatures(_Explicit):
    """Keep only the listed features, in the listed order."""

    def apply(self, frame: Frame) -> Frame:
        self.check(frame)
        return select_features(frame, self.features)


def _threshold(value: float) -> float:
    if not isinstance(value, float):
        raise TypeError("threshold must be a float")
    return value


class DropSparseRows:
    """Keep a row iff its nulls number fewer than int(features * threshold)."""

    def __init__(self, threshold: float = 0.5):
        self.threshold = _threshold(threshold)

    def apply(self, frame: Frame) -> Frame:
        tolerance = int(frame.n_features * self.threshold)
        nulls = sum((is_missing(frame, n).cast("int") for n in frame.features), F.lit(0))
        return frame.where(nulls < F.lit(tolerance))


class DropSparseFeatures:
    """Drop a feature iff its nulls exceed int(rows * threshold)."""

    def __init__(self, threshold: float = 0.5):
        self.threshold = _threshold(threshold)

    def apply(self, frame: Frame) -> Frame:
        counts = frame.df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(is_missing(frame, n)).alias(f"n{i}")
              for i, n in enumerate(frame.features)]).first()
        tolerance = int(counts["rows"] * self.threshold)
        kept = [n for i, n in enumerate(frame.features) if counts[f"n{i}"] <= tolerance]
        if not kept:
            raise IndexError("every feature has too many nulls; raise the threshold or impute")
        return frame.rebuild({n: col(n) for n in kept})
