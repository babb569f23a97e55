"""Fit and predict on frames.

``fit(frame)`` returns a fitted object whose ``predict(frame)`` gives the keys
of each row plus ``pred`` (a class) and ``proba`` (class name -> probability).
Any classifier of pyspark.ml serves through ``EstimatorClassifier``; any other
object with these two methods serves as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.frame import Frame, col
from foldwise.functions.ordered import class_counts
from foldwise.functions.vectors import (VECTOR, class_index, class_map, class_value,
                                        first_largest, with_vector)

INDEX = "label_index"
WEIGHT = "class_weight"
PARTITION_BYTES = 32 * 2**20


@dataclass(frozen=True)
class Training:
    """Rows ready for a pyspark.ml estimator."""

    df: DataFrame
    classes: tuple
    rows: int
    counts: tuple[int, ...]


def training_set(frame: Frame) -> Training:
    counts = class_counts(frame.df, frame.label)
    if len(counts) < 2:
        raise ValueError("a classifier needs at least two classes in its training rows")
    classes = tuple(c for c, _ in counts)
    rows = sum(n for _, n in counts)
    df = with_vector(frame).withColumn(INDEX, class_index(col(frame.label), classes))
    # An optimiser passes over the rows many times, so they are dealt to as few
    # tasks as their size asks for. A shuffle, so that what makes the rows keeps
    # its own partitions.
    partitions = max(1, math.ceil(rows * 8 * frame.n_features / PARTITION_BYTES))
    return Training(df.select(VECTOR, INDEX).repartition(partitions), classes, rows,
                    tuple(n for _, n in counts))


def predictions(df: DataFrame, keys: tuple[str, ...], classes: tuple, proba: Column,
                index: Column | None = None) -> DataFrame:
    """The common output: keys, predicted class, probability per class."""
    with_p = df.withColumn("__p", proba)
    index = first_largest(F.col("__p")) if index is None else index
    return with_p.select(*[col(k) for k in keys], class_value(index, classes).alias("pred"),
                         class_map(F.col("__p"), classes).alias("proba"))


def as_trained(frame: Frame, features: tuple[str, ...]) -> Frame:
    """The frame with the features a model has learned, in its order; raises if one is missing."""
    if set(features) != set(frame.features):
        raise ValueError(f"trained on {list(features)}, given {list(frame.features)}")
    return replace(frame, features=tuple(features))


@dataclass(frozen=True)
class FittedEstimator:
    model: Model
    classes: tuple
    features: tuple[str, ...]

    def predict(self, frame: Frame) -> DataFrame:
        frame = as_trained(frame, self.features)
        scored = self.model.transform(with_vector(frame))
        return predictions(scored, frame.keys, self.classes,
                           vector_to_array("probability"), F.col("prediction"))


def checked_weights(class_weight):
    """None, "balanced", or a weight for some of the classes."""
    if class_weight is None or class_weight == "balanced":
        return class_weight
    if not isinstance(class_weight, dict) or any(w < 0 for w in class_weight.values()):
        raise ValueError(f"class_weight must be None, 'balanced' or a dict, not {class_weight!r}")
    return dict(class_weight)


def class_weights(train: Training, class_weight) -> list[float]:
    """The weight of a row of each class; balanced: every class weighs the same in all."""
    if class_weight == "balanced":
        return [train.rows / (len(train.classes) * n) for n in train.counts]
    unknown = [c for c in class_weight or {} if c not in train.classes]
    if unknown:
        raise ValueError(f"class_weight names no class of the training rows: {unknown}")
    return [float((class_weight or {}).get(c, 1.0)) for c in train.classes]


def weigh(train: Training, class_weight) -> DataFrame:
    """The training rows with the column ``weight``."""
    weights = F.array(*[F.lit(w) for w in class_weights(train, class_weight)])
    return train.df.withColumn(WEIGHT, F.element_at(weights, F.col(INDEX).cast("int") + 1))


class EstimatorClassifier:
    """A pyspark.ml classifier that reports probabilities."""

    class_weight = None

    def __init__(self, estimator: Estimator):
        self._estimator = estimator

    def estimator(self, rows: int, n_features: int) -> Estimator:
        return self._estimator

    def fit(self, frame: Frame) -> FittedEstimator:
        train = training_set(frame)
        estimator = self.estimator(train.rows, frame.n_features).copy()
        estimator.setFeaturesCol(VECTOR).setLabelCol(INDEX)
        rows = train.df
        if self.class_weight is not None:
            rows = weigh(train, self.class_weight)
            estimator.setWeightCol(WEIGHT)
        return FittedEstimator(estimator.fit(rows), train.classes, frame.features)


def sampled_parameters(classifier: type, parameters: dict) -> list[str]:
    """The parameters that matter given the others; the rest stays unset."""
    rule = getattr(classifier, "sampled", None)
    return rule(parameters) if rule else list(parameters)
