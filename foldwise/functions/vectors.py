"""Between feature columns, arrays and the vectors pyspark.ml works on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.frame import Frame, quoted

VECTOR = "features_vector"


def _numeric(frame: Frame) -> list[str]:
    """Quoted feature names; text cannot go into a matrix."""
    kinds = {f.name: f.dataType for f in frame.df.schema.fields}
    wrong = [n for n in frame.features
             if not isinstance(kinds[n], (T.NumericType, T.BooleanType))]
    if wrong:
        raise TypeError(f"a matrix needs numeric features; encode or drop {wrong}")
    return [quoted(n) for n in frame.features]


def with_vector(frame: Frame) -> DataFrame:
    """Keys and one vector of all features, in feature order; nulls raise."""
    names = _numeric(frame)
    # SQL text: one call to the JVM per column, whatever the number of features.
    plain = frame.df.selectExpr(*[quoted(k) for k in frame.keys],
                                *[f"CAST({n} AS DOUBLE) AS __f{i}" for i, n in enumerate(names)])
    assembler = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(names))],
                                outputCol=VECTOR, handleInvalid="error")
    return assembler.transform(plain).selectExpr(*[quoted(k) for k in frame.keys], VECTOR)


def feature_array(frame: Frame) -> Column:
    """All features as array<double>; a null raises when the row is read."""
    names = _numeric(frame)
    missing = " OR ".join(f"{n} IS NULL" for n in names)
    cells = ", ".join(f"CAST({n} AS DOUBLE)" for n in names)
    return F.expr(f"CASE WHEN {missing} THEN CAST(raise_error('features hold nulls; impute "
                  f"them first') AS ARRAY<DOUBLE>) ELSE array({cells}) END")


def class_index(label: Column, classes: Sequence) -> Column:
    """Place of the label in the sorted classes; null for an unknown label."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    return F.when(place > 0, (place - 1).cast("double"))


def class_value(index: Column, classes: Sequence) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), index.cast("int") + 1)


def class_map(probabilities: Column, classes: Sequence) -> Column:
    """Probability by class name as SQL writes it, classes in sorted order."""
    return F.map_from_arrays(F.array(*[F.lit(c).cast("string") for c in classes]), probabilities)


def first_largest(values: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(values, F.array_max(values)) - 1
