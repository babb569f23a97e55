"""Counts of categories of any number: only those that are asked for reach the driver.

The values of a feature are counted by slice and written once. Cells add up the
slices they train on; which values are frequent is decided in Spark, by rank
within each cell. Whether a value was seen in training is answered by a join
with the written table when there are too many values for an expression.
"""

from __future__ import annotations

from collections.abc import Hashable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.frame import Frame, col
from foldwise.operators.base import Cells, parse_value
from foldwise.session import scratch_dir

# Up to so many values are looked up in an expression, more by a join.
INLINE_VALUES = 100


@dataclass(frozen=True)
class Members:
    """All values that a feature has in the training rows of a cell, as a table."""

    table: DataFrame
    slices: tuple[int, ...] | None

    def flagged(self, df: DataFrame, feature: str, out: str) -> DataFrame:
        """The rows with a column that tells whether the feature's value is a member."""
        own = self.table
        if self.slices is not None:
            own = own.where(F.exists("parts", lambda p: p["s"].isin(list(self.slices))))
        own = own.select(F.col("value").alias("__value"), F.lit(True).alias("__member"))
        joined = df.join(own, col(feature).eqNullSafe(F.col("__value")), "left")
        return joined.withColumn(out, F.coalesce("__member", F.lit(False))).drop("__value", "__member")


@dataclass(frozen=True)
class Counted:
    """What a cell needs of one feature: asked values in sorted order, null last."""

    values: tuple
    counts: tuple[int, ...]
    # Of the whole cell: rows, distinct values (null is one), and values of at least the
    # asked count.
    rows: int
    distinct: int
    frequent: int


class Tally:
    """Rows per value and slice of one feature, for all cells of a fit.

    Few values are held by the driver, from one job; more are written once.
    """

    def __init__(self, frame: Frame, feature: str, cells: Cells | dict, by: str | None):
        spark = frame.df.sparkSession
        slot = F.lit(0) if by is None else col(by)
        self.kind = frame.type_of(feature)
        self.cells = {k: None if by is None else tuple(s) for k, s in cells.items()}
        counts = frame.df.groupBy(col(feature).alias("value"), slot.alias("s")).count()
        parts = counts.groupBy("value").agg(F.collect_list(F.struct("s", "count")).alias("parts"))
        rows = parts.select(F.col("value").cast("string").alias("v"), "parts").limit(INLINE_VALUES + 1).collect()
        # By value the rows of each slice.
        self.few: dict | None = None
        if len(rows) <= INLINE_VALUES:
            self.few = {parse_value(r["v"], self.kind): dict(map(tuple, r["parts"])) for r in rows}
        else:
            path = scratch_dir(spark, "categories")
            parts.write.parquet(path)
            self.table = spark.read.parquet(path)

    def _own(self, key: Hashable) -> dict:
        """Rows by value of a cell, if values are few."""
        slices = self.cells[key]
        sums = {v: sum(n for s, n in parts.items() if slices is None or s in slices)
                for v, parts in self.few.items()}
        return {v: n for v, n in sums.items() if n}

    def _long(self) -> DataFrame:
        """(cell, value, n): rows of each value in each cell that has it."""
        def rows(slices: tuple[int, ...] | None) -> Column:
            own = "parts" if slices is None else F.filter("parts", lambda p: p["s"].isin(list(slices)))
            return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, p: total + p["count"])

        sums = [F.struct(F.lit(i).alias("cell"), rows(slices).alias("n"))
                for i, slices in enumerate(self.cells.values())]
        long = self.table.select("value", F.explode(F.array(*sums)).alias("e"))
        return long.select("value", "e.cell", "e.n").where("n > 0")

    def most_frequent(self, most: int, least: int | float | None = None) -> dict[Hashable, Counted]:
        """The ``most`` most frequent values of each cell that reach the count ``least``, a
        number of rows or a share of the cell's.

        Of equal counts the later value counts as more frequent, null as the latest.
        """
        if self.few is not None:
            return {k: self._few_of(k, most, least) for k in self.cells}
        long = self._long()
        order = [F.col("n").desc(), F.col("value").isNull().desc(), F.col("value").desc()]
        sizes = F.broadcast(long.groupBy("cell").agg(F.sum("n").alias("rows")))  # a row a cell
        enough = long.join(sizes, "cell")
        if least is not None:
            share = F.col("rows") if isinstance(least, float) else F.lit(1)
            enough = enough.where(F.col("n") >= F.lit(least) * share)
        ranked = enough.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(*order)))
        return self._collected(ranked.where(F.col("rank") <= most), enough)

    def _few_of(self, key: Hashable, most: int, least: int | float | None) -> Counted:
        own = self._own(key)
        rows = sum(own.values())
        needed = least * rows if isinstance(least, float) else least or 0
        ascending = _sorted(list(own))
        ranked = sorted((v for v in ascending if own[v] >= needed), key=lambda v: own[v])[::-1]
        # A stable sort, turned round: of equal counts the later value comes first.
        values = _sorted(ranked[:most])
        return Counted(values, tuple(own[v] for v in values), rows, len(own), len(ranked))

    def among(self, values: list) -> dict[Hashable, Counted]:
        """The counts of the given values."""
        if self.few is not None:
            out = {}
            for k in self.cells:
                own = self._own(k)
                found = _sorted([v for v in own if v is not None and v in values])
                out[k] = Counted(found, tuple(own[v] for v in found), sum(own.values()), len(own),
                                 len(found))
            return out
        typed = [F.lit(v).cast(self.kind) for v in values]
        asked = self._long().where(F.col("value").isin(typed))
        return self._collected(asked, asked)

    def known(self, key: Hashable) -> tuple | Members:
        """All values of a cell, null last; as a table unless they are few."""
        if self.few is None:
            return Members(self.table, self.cells[key])
        return _sorted(list(self._own(key)))

    def _collected(self, asked: DataFrame, enough: DataFrame) -> dict[Hashable, Counted]:
        totals = {r["cell"]: r for r in self._long().groupBy("cell").agg(
            F.sum("n").alias("rows"), F.count("*").alias("distinct")).collect()}
        frequent = {r["cell"]: r["count"] for r in enough.groupBy("cell").count().collect()}
        found: dict[int, dict] = {}
        for r in asked.select("cell", F.col("value").cast("string").alias("v"), "n").collect():
            found.setdefault(r["cell"], {})[parse_value(r["v"], self.kind)] = r["n"]
        out = {}
        for i, key in enumerate(self.cells):
            own = found.get(i, {})
            values = _sorted(list(own))
            total = totals.get(i)
            out[key] = Counted(values, tuple(own[v] for v in values), total["rows"] if total else 0,
                               total["distinct"] if total else 0, frequent.get(i, 0))
        return out


def _sorted(values: list) -> tuple:
    some = sorted(v for v in values if v is not None)
    return (*some, None) if None in values else tuple(some)
