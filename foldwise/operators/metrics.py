"""Metrics as grouped aggregations over a predictions table.

A predictions table has any number of cell columns (run, replicate, trial,
stage, cross, ...) and ``label``, ``pred`` and ``proba``; every metric is
computed for all cells in the same job. Labels are first reduced to a small
(cell, label, pred) count table with map-side combine, from which all
label-based metrics follow.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.frame import Frame, col
from foldwise.functions.hashing import order_key
from foldwise.functions.ordered import BUCKET_ROWS, running_totals

EPSILON = sys.float_info.epsilon


def _keys(by: Sequence[str]) -> list[Column]:
    return [col(b) for b in by]


def _all(df: DataFrame, by: Sequence[str]):
    """Group by the cells; without cells, one group that exists if rows do."""
    return df.groupBy(*_keys(by))


# --- Probabilities -----------------------------------------------------------

def true_class_probability() -> Column:
    return F.coalesce(F.element_at("proba", F.col("label").cast("string")), F.lit(0.0))


def log_loss(preds: DataFrame, by: Sequence[str] = (), p: Column | None = None) -> DataFrame:
    """Mean of -ln p(true class), p clipped to [eps, 1 - eps]."""
    p = true_class_probability() if p is None else p
    clipped = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    return _all(preds, by).agg(F.avg(-F.log(clipped)).alias("log_loss"))


def roc_auc(preds: DataFrame, by: Sequence[str] = (), score: Column | None = None,
            positive: Column | None = None) -> DataFrame:
    """Area under the ROC curve in its exact rank form, ties counted half.

    The score is the probability of the second class unless given. Rows are
    first added up per distinct score; negatives below a score are a running
    total that no single task has to sort.
    """
    if score is None:
        binary = F.size("proba") == 2
        complaint = F.raise_error(F.concat(
            F.lit("ROC AUC needs two classes, found "), F.size("proba").cast("string")))
        score = F.when(binary, F.map_values("proba")[1]).otherwise(complaint.cast("double"))
        positive = F.col("label").cast("string") == F.map_keys("proba")[1]
    counted = preds.select(*_keys(by), score.alias("__score"), positive.alias("__hit"))
    tally = counted.groupBy(*_keys(by), "__score").agg(
        F.count_if(F.col("__hit")).alias("__pos"), F.count_if(~F.col("__hit")).alias("__neg"))
    below = running_totals(tally, by, "__score", {"__neg": "__below"})
    won = F.sum(F.col("__pos") * (F.col("__below") + F.col("__neg") / 2))
    pairs = F.sum("__pos") * F.sum("__neg")
    return _all(below, by).agg(F.try_divide(won, pairs).alias("roc_auc"))


# --- Labels ------------------------------------------------------------------

def class_table(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(cell, class, tp, n_true, n_pred) for every class in truth or prediction."""
    confusion = preds.groupBy(*_keys(by), "label", "pred").count()
    kind = preds.schema["label"].dataType
    ends = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("count").alias("n_true"),
                 F.lit(0).cast("bigint").alias("n_pred")),
        F.struct(F.col("pred").cast(kind).alias("class"), F.lit(0).cast("bigint").alias("n_true"),
                 F.col("count").alias("n_pred")))).alias("e")
    hit = F.when((F.col("label") == F.col("pred")) & (F.col("n_true") > 0), F.col("n_true"))
    return (confusion.select(*_keys(by), "label", "pred", ends)
            .select(*_keys(by), "label", "pred", "e.class", "e.n_true", "e.n_pred")
            .groupBy(*_keys(by), "class")
            .agg(F.coalesce(F.sum(hit), F.lit(0)).alias("tp"),
                 F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred")))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def _score(kind: str) -> Column:
    tp, n_true, n_pred = F.col("tp"), F.col("n_true"), F.col("n_pred")
    return {"precision": _ratio(tp, n_pred), "recall": _ratio(tp, n_true),
            "f1": _ratio(2 * tp, n_true + n_pred)}[kind]


def balanced_accuracy(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes present in truth."""
    present = class_table(preds, by).filter(F.col("n_true") > 0)
    return _all(present, by).agg(F.avg(_score("recall")).alias("balanced_accuracy"))


def weighted_average(preds: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall or f1 per class, averaged with the true counts."""
    total = F.sum(_score(kind) * F.col("n_true")) / F.sum("n_true")
    return _all(class_table(preds, by), by).agg(total.alias(kind))


def per_class(preds: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall or f1 of each class, in long form."""
    return class_table(preds, by).select(*_keys(by), "class", _score(kind).alias(kind))


def per_class_map(preds: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """The same as one map per cell, class name -> score, in class order."""
    rows = per_class(preds, kind, by)
    ordered = F.array_sort(F.collect_list(F.struct("class", kind)))
    named = F.transform(ordered, lambda e: F.struct(e["class"].cast("string"), e[kind]))
    return _all(rows, by).agg(F.map_from_entries(named).alias(kind))


# --- Rows --------------------------------------------------------------------

def correct_rows(preds: DataFrame) -> DataFrame:
    """The rows predicted right, one per row of the result, never elided."""
    return preds.filter(F.col("pred") == F.col("label"))


def incorrect_rows(preds: DataFrame) -> DataFrame:
    return preds.filter(F.col("pred") != F.col("label"))


# --- Importance --------------------------------------------------------------

def permutation_importance(model, frame: Frame, repeats: int = 5, seed: int = 0,
                           bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(feature, importance): mean loss of accuracy when a feature is shuffled.

    Rows get a seeded random order per repeat and each row takes the value of
    the next row in it; the last takes the first. The order is cut at leading
    digits of its key, so that no task sorts all rows; the last row of a piece
    takes the first of the next one, so the cuts change no result. All features
    and repeats share one shuffle and one prediction pass.
    """
    base = model.predict(frame).agg(
        F.avg((F.col("pred") == F.col("label")).cast("int")).alias("accuracy"),
        F.count(F.lit(1)).alias("rows")).first()
    digits = max(0, math.ceil(math.log(max(1, base["rows"] / bucket_rows), 16)))
    names = list(frame.features)
    rid = col(frame.row_id)
    copies = frame.df.withColumn("__repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = (copies.withColumn("__h", order_key(seed, F.col("__repeat"), rid))
              .withColumn("__b", F.substring("__h", 1, digits)))
    packed = F.struct(*[col(n).alias(f"f{i}") for i, n in enumerate(names)])
    order = Window.partitionBy("__repeat", "__b").orderBy("__h", rid)
    heads = (copies.withColumn("__x", packed).groupBy("__repeat", "__b")
             .agg(F.min_by("__x", F.struct(F.col("__h"), rid)).alias("__head")))
    # One row for each (repeat, piece).
    pieces = Window.partitionBy("__repeat").orderBy("__b")
    whole = pieces.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("__repeat", "__b", F.coalesce(
        F.lead("__head").over(pieces), F.first("__head").over(whole)).alias("__after"))
    copies = (copies.withColumn("__lead", F.lead(packed).over(order))
              .join(heads, ["__repeat", "__b"])
              .withColumn("__next", F.coalesce("__lead", "__after")))
    spread = copies.withColumn("__f", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    one_id = F.concat_ws("|", rid.cast("string"), F.col("__repeat"), F.col("__f"))
    mixed = spread.select(
        one_id.alias(frame.row_id), col(frame.label), "__repeat", "__f",
        *[F.when(F.col("__f") == i, F.col(f"__next.f{i}")).otherwise(col(n)).alias(n)
          for i, n in enumerate(names)])
    shuffled = Frame(mixed, frame.features, (frame.row_id, frame.label, "__repeat", "__f"),
                     frame.row_id, frame.label)
    scored = model.predict(shuffled)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__f") + 1)
    lost = F.lit(base["accuracy"]) - F.avg((F.col("pred") == F.col("label")).cast("int"))
    return (scored.groupBy("__f").agg(lost.alias("importance"))
            .select(name.alias("feature"), "importance")
            .orderBy(F.abs("importance").desc(), "feature"))


# --- By name -----------------------------------------------------------------

# The metric names a study spec uses.
SCALAR_METRICS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {
    "log_loss": log_loss,
    "balanced_accuracy": balanced_accuracy,
    "roc_auc": roc_auc,
    "sk_precision_weighted_avg": lambda p, by: weighted_average(p, "precision", by),
    "sk_recall_weighted_avg": lambda p, by: weighted_average(p, "recall", by),
    "sk_f1_weighted_avg": lambda p, by: weighted_average(p, "f1", by),
}
CLASS_METRICS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {
    "sk_precision_perclass": lambda p, by: per_class_map(p, "precision", by),
    "sk_recall_perclass": lambda p, by: per_class_map(p, "recall", by),
    "sk_f1_perclass": lambda p, by: per_class_map(p, "f1", by),
}
ROW_METRICS = {"correct_samples": correct_rows, "incorrect_samples": incorrect_rows}
IMPORTANCE = "importance_by_permutation"
# The direction in which a scalar metric improves.
MINIMISED = {"log_loss"}


@dataclass(frozen=True)
class FeatureMetric:
    """A user's metric that needs features: ``compute(rows, by)`` as other metrics, over
    predictions that have the named features as columns too."""

    compute: Callable[[DataFrame, Sequence[str]], DataFrame]
    features: tuple[str, ...]

    def __call__(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return self.compute(rows, by)


@dataclass(frozen=True)
class ModelMetric:
    """A user's metric of a fitted model and the rows it is scored on (features and label), a
    number: ``compute(model, frame)``. Called once for each cell."""

    compute: Callable[[object, Frame], float | None]


def with_features(preds: DataFrame, frame: Frame, features: Sequence[str],
                  row_id: str | None = None) -> DataFrame:
    """Predictions with features of their rows; ``row_id`` is their key, if named otherwise."""
    own = frame.df.select(col(frame.row_id).alias("__id"), *[
        col(f) for f in frame.require(features)])
    return preds.join(own, col(row_id or frame.row_id) == F.col("__id")).drop("__id")


def known_metrics() -> set[str]:
    return {*SCALAR_METRICS, *CLASS_METRICS, *ROW_METRICS, IMPORTANCE}


def evaluate(preds: DataFrame, by: Sequence[str], names: Sequence[str],
             custom: dict[str, Callable] | None = None) -> DataFrame:
    """(cell, metric, value, classes): scalar and per-class metrics in long form."""
    parts = []
    for name in names:
        scalar = {**SCALAR_METRICS, **(custom or {})}.get(name)
        found = (scalar or CLASS_METRICS[name])(preds, by)
        out = col(found.columns[-1])
        none = F.lit(None)
        parts.append(found.select(
            *_keys(by), F.lit(name).alias("metric"),
            (out if scalar else none).cast("double").alias("value"),
            (none if scalar else out).cast("map<string,double>").alias("classes")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
