"""Training rows of many cells in one table, and sums over them in one job.

A cell is one fit: a (replicate, cross) of a trial. Cells that read the same
frame differ only in which slices they train on, so a row is held once for each
frame, not once for each cell. A step of a fit is one job for all cells: tasks
sum what each cell needs over their rows, Spark adds the partial sums by cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.frame import Frame, col
from foldwise.functions.vectors import class_index, feature_array
from foldwise.models.base import PARTITION_BYTES
from foldwise.operators.folds import SLICE, side

# What all cells of one job may send to the driver, in numbers of 8 bytes.
DRIVER_NUMBERS = 4 * 2**20


@dataclass(frozen=True)
class TrainSide:
    """The rows that a cell trains on: those of some slices of a frame, or all."""

    frame: Frame
    slices: tuple[int, ...] | None = None

    def rows(self) -> Frame:
        return self.frame if self.slices is None else side(self.frame, list(self.slices))


@dataclass(frozen=True)
class Cell:
    """What the driver knows of a cell's training rows."""

    source: int
    # Its place among the cells of its source.
    at: int
    slices: frozenset[int] | None
    features: tuple[str, ...]
    classes: tuple
    # Place of each of its classes among the classes of all cells.
    places: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def rows(self) -> int:
        return sum(self.counts)

    def holds(self, slices: np.ndarray) -> np.ndarray | slice:
        """Which of the rows with these slices belong to the cell."""
        return slice(None) if self.slices is None else np.isin(slices, list(self.slices))

    def local(self, labels: np.ndarray) -> np.ndarray:
        """Classes of rows as numbers among the cell's own classes."""
        table = np.full(max(self.places) + 1, -1)
        table[list(self.places)] = range(len(self.places))
        return table[labels]


@dataclass(frozen=True)
class CellRows:
    """All training rows (source, slice, x, y), kept while the cells are fitted.

    A model may add a column v with a number for each cell of the row's source.
    Packed rows are blocks of a source: slices, x and y as bytes, so that a pass
    turns no row into an object or a list.
    """

    df: DataFrame
    cells: dict[Hashable, Cell]

    def release(self) -> None:
        self.df.unpersist()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column("source").to_numpy(zero_copy_only=False)
        for source in np.unique(every):
            part = batch.filter(pa.array(every == source))
            x = np.ascontiguousarray(_matrix(part.column("x")))
            whole = [part.column(n).to_numpy(zero_copy_only=False).astype(np.int32) for n in ("slice", "y")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([source], pa.int32()), *[pa.array([a.tobytes()], pa.binary())
                                                   for a in (whole[0], x, whole[1])]],
                names=["source", "slice", "x", "y"])


def gather(sides: dict[Hashable, TrainSide], packed: bool = False) -> CellRows:
    """The rows of all sides, each frame once, and the class counts of all cells."""
    frames = list({id(s.frame): s.frame for s in sides.values()}.values())
    source_of = {id(f): i for i, f in enumerate(frames)}
    sliced = {id(s.frame) for s in sides.values() if s.slices is not None}
    counted = reduce(DataFrame.unionByName, [
        f.df.groupBy(F.lit(i).alias("source"), _slice(f, sliced).alias("slice"),
                     col(f.label).alias("label")).count() for i, f in enumerate(frames)])
    table = {}
    for r in counted.where(F.col("label").isNotNull()).collect():
        table.setdefault(r["source"], []).append((r["slice"], r["label"], r["count"]))
    classes = sorted({label for own in table.values() for _, label, _ in own})
    cells = {}
    for key, s in sides.items():
        source = source_of[id(s.frame)]
        slices = None if s.slices is None else frozenset(s.slices)
        counts: dict = {}
        for at, label, n in table.get(source, []):
            if slices is None or at in slices:
                counts[label] = counts.get(label, 0) + n
        own = sorted(counts)
        if len(own) < 2:
            raise ValueError("a classifier needs at least two classes in its training rows")
        at = sum(c.source == source for c in cells.values())
        cells[key] = Cell(source, at, slices, s.frame.features, tuple(own),
                          tuple(classes.index(c) for c in own), tuple(counts[c] for c in own))
    rows = reduce(DataFrame.unionByName, [
        f.df.select(F.lit(i).alias("source"), _slice(f, sliced).alias("slice"),
                    feature_array(f).alias("x"),
                    class_index(col(f.label), classes).cast("int").alias("y"))
        for i, f in enumerate(frames)]).where(F.col("y").isNotNull())
    n = sum(count for own in table.values() for _, _, count in own)
    width = max(f.n_features for f in frames)
    partitions = max(1, math.ceil(n * 8 * width / PARTITION_BYTES))
    rows = rows.repartition(partitions)
    if packed:
        rows = rows.mapInArrow(_packed, "source int, slice binary, x binary, y binary")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    return CellRows(rows, cells)


def _slice(frame: Frame, sliced: set[int]):
    return (col(SLICE) if id(frame) in sliced else F.lit(0)).cast("int")


Work = Callable[[Hashable, Cell, np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix; none is made a Python object."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(
        len(column), -1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(source, slices, x, y, v) of the rows of each source; v may be None."""
    if pa.types.is_binary(batch.column("x").type):
        for row in zip(*[batch.column(n) for n in ("source", "slice", "x", "y")]):
            slices, y = (np.frombuffer(row[i].as_buffer(), np.int32) for i in (1, 3))
            yield row[0].as_py(), slices, np.frombuffer(row[2].as_buffer(), float).reshape(len(y), -1), y, None
        return
    every = batch.column("source").to_numpy(zero_copy_only=False)
    for source in np.unique(every):
        part = batch if (every == source).all() else batch.filter(pa.array(every == source))
        slices, y = (part.column(n).to_numpy(zero_copy_only=False) for n in ("slice", "y"))
        v = _matrix(part.column("v")) if "v" in part.schema.names else None
        yield source, slices, _matrix(part.column("x")), y, v


def summed(rows: CellRows, keys: list[Hashable], work: Work) -> dict[Hashable, np.ndarray]:
    """For each cell the sum of ``work(key, cell, x, y, v)`` over its rows, in one job.

    ``work`` gets some rows as a matrix, their classes, numbered among the
    cell's own, and the cell's number of each row (None without the column v);
    it returns numbers that add up.
    """
    cells = [(i, key, rows.cells[key]) for i, key in enumerate(keys)]
    sources = sorted({c.source for _, _, c in cells})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for source, slices, x, y, v in _blocks(batch):
                for i, key, cell in cells:
                    if cell.source != source:
                        continue
                    held = cell.holds(slices)
                    own = x[held]
                    if len(own):
                        numbers = None if v is None else v[held][:, cell.at]
                        part_sum = work(key, cell, own, cell.local(y[held]), numbers)
                        totals[i] = totals[i] + part_sum if i in totals else part_sum
        for i, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([np.asarray(total, dtype=float)])],
                names=["cell", "sums"])

    partial = rows.df.where(F.col("source").isin(sources)).mapInArrow(
        run, "cell int, sums array<double>")
    total = partial.groupBy("cell").agg(
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    return {keys[r["cell"]]: np.array(r["sums"]) for r in total.collect()}


def waves(keys: list[Hashable], size: Callable[[Hashable], int]) -> Iterator[list[Hashable]]:
    """Cells in groups whose sums fit the driver; one group unless they are very wide."""
    wave, total = [], 0
    for key in keys:
        if wave and total + size(key) > DRIVER_NUMBERS:
            yield wave
            wave, total = [], 0
        wave.append(key)
        total += size(key)
    if wave:
        yield wave
