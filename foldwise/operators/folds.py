"""Stratified replicate folds and the cross folds nested inside each of them.

All folds follow from one number per row: its position in (class, seeded
random order). With R replicates and C crosses

* the replicate whose test side holds the row is ``position % R``;
* among the rows outside replicate r's test side, the row comes
  ``position - (rows of r before it)``-th, and that number ``% C`` is its
  cross fold in replicate r. The rows of r before it are counted by division.

Both depend only on ``position % (R * C)``, here called the slice. A row
therefore carries one small integer, no row is copied per fold, and a train
side is a set of slices. Statistics that can be merged are computed once per
slice and added up for every (replicate, cross) cell.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwise.frame import Frame, col
from foldwise.functions.ordered import BUCKET_ROWS, ClassSizes, class_positions

SLICE = "slice"


@dataclass(frozen=True)
class FoldPlan:
    """Which slices belong to which side of which split."""

    replicates: int
    crosses: int = 1

    def __post_init__(self) -> None:
        if self.replicates < 2:
            raise ValueError("at least 2 replicates are needed to hold rows out")
        if self.crosses < 1:
            raise ValueError("crosses must be at least 1")

    @property
    def slices(self) -> range:
        return range(self.replicates * self.crosses)

    def replicate_of(self, s: int) -> int:
        return s % self.replicates

    def cross_of(self, s: int, replicate: int) -> int:
        ahead = (s + self.replicates - 1 - replicate) // self.replicates
        return (s - ahead) % self.crosses

    def out_group(self, replicate: int) -> list[int]:
        return [s for s in self.slices if self.replicate_of(s) == replicate]

    def in_group(self, replicate: int) -> list[int]:
        return [s for s in self.slices if self.replicate_of(s) != replicate]

    def cross_test(self, replicate: int, cross: int) -> list[int]:
        return [s for s in self.in_group(replicate) if self.cross_of(s, replicate) == cross]

    def cross_train(self, replicate: int, cross: int) -> list[int]:
        return [s for s in self.in_group(replicate) if self.cross_of(s, replicate) != cross]

    # The same two numbers as columns.
    def replicate_column(self) -> Column:
        return (F.col(SLICE) % self.replicates).cast("int")

    def cross_column(self, replicate: int | Column) -> Column:
        r = F.lit(replicate) if isinstance(replicate, int) else replicate
        s = F.col(SLICE)
        ahead = F.floor((s + F.lit(self.replicates - 1) - r) / F.lit(self.replicates))
        place = ((s - ahead) % self.crosses).cast("int")
        return F.when(self.replicate_column() != r, place)


def assign_slices(frame: Frame, plan: FoldPlan, seed: int = 71554,
                  bucket_rows: int = BUCKET_ROWS) -> Frame:
    """Add the slice column; a row is on the test side of one replicate."""
    if SLICE in frame.df.columns:
        raise ValueError(f"the table already has a column {SLICE!r}; rename it")
    need = max(plan.replicates, plan.crosses)
    sizes = ClassSizes.of(frame.df, frame.label, need)
    if sizes.classes and sizes.largest < plan.replicates:
        raise ValueError(f"no class has {plan.replicates} rows")
    if sizes.small:
        warnings.warn(f"classes with fewer than {need} rows: {list(sizes.some)}", stacklevel=2)
    placed = class_positions(frame.df, frame.label, frame.row_id, seed, sizes,
                             bucket_rows, out="__position")
    sliced = (placed.withColumn(SLICE, (F.col("__position") % len(plan.slices)).cast("int"))
              .drop("__position"))
    return replace(frame, df=sliced, keys=(*frame.keys, SLICE))


def side(frame: Frame, slices: list[int]) -> Frame:
    """The rows of the given slices."""
    return frame.where(col(SLICE).isin(slices))


def nested_folds(frame: Frame, plan: FoldPlan):
    """(keys, replicate, fold): every row once per replicate that trains on it.

    The in-group rows of every replicate with their cross fold; a reporting
    view only, the engine itself works on slices.
    """
    per_replicate = F.explode(F.array(*[
        F.struct(F.lit(r).alias("replicate"), plan.cross_column(r).alias("cross"))
        for r in range(plan.replicates)])).alias("e")
    long = frame.df.select(*[col(k) for k in frame.keys], per_replicate)
    return (long.select(*[col(k) for k in frame.keys], "e.replicate", "e.cross")
            .filter(F.col("cross").isNotNull()))
