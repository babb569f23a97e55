"""Exact order statistics that never sort a whole group in one task.

A plain ``row_number() over (partition by label ...)`` sorts a class in one
task, and one class may hold a third of all rows. Here a group is first cut
into ordered buckets; rows are numbered inside a bucket, and a running total
over the bucket counts (a small table) supplies the rest.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.frame import col
from foldwise.functions.hashing import order_key
from foldwise.session import scratch_dir

# Rows that one task may sort comfortably.
BUCKET_ROWS = 200_000
# Classes of a classifier, which are columns of its output; folds know no such limit.
MAX_CLASSES = 100_000
# Classes that an expression may list.
LISTED = 200
# Conditional aggregates that one job computes side by side.
SERIES_PER_JOB = 200


def class_counts(df: DataFrame, label: str) -> list[tuple[object, int]]:
    """Sorted (class, rows); the classes of a classifier fit on the driver."""
    found = df.groupBy(col(label).alias("c")).count().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label!r}")
    if any(r["c"] is None for r in found):
        raise ValueError(f"target {label!r} holds nulls")
    return sorted((r["c"], r["count"]) for r in found)


@dataclass(frozen=True)
class ClassSizes:
    """Rows of each class: listed if they are few, else a table (c, n)."""

    listed: list[tuple[object, int]] | None
    table: DataFrame | None
    classes: int
    largest: int
    # Classes with fewer rows than asked for: how many, and some of them.
    small: int
    some: tuple

    @staticmethod
    def of(df: DataFrame, label: str, least: int = 0) -> "ClassSizes":
        counts = df.groupBy(col(label).alias("c")).agg(F.count(F.lit(1)).alias("n"))
        rows = counts.limit(LISTED + 1).collect()
        missing = f"target {label!r} holds nulls"
        if len(rows) <= LISTED:
            if any(r["c"] is None for r in rows):
                raise ValueError(missing)
            listed = sorted((r["c"], r["n"]) for r in rows)
            some = tuple(c for c, n in listed if n < least)
            return ClassSizes(listed, None, len(listed), max((n for _, n in listed), default=0),
                              len(some), some[:10])
        path = scratch_dir(df.sparkSession, "classes")
        counts.write.parquet(path)
        table = df.sparkSession.read.parquet(path)
        few = F.col("n") < least
        told = table.agg(
            F.count(F.lit(1)).alias("classes"), F.max("n").alias("largest"), F.count_if(few).alias("small"),
            F.count_if(F.col("c").isNull()).alias("nulls")).first()
        if told["nulls"]:
            raise ValueError(missing)
        some = (tuple(r["c"] for r in table.where(few).orderBy("c").limit(10).collect())
                if told["small"] else ())
        return ClassSizes(None, table, told["classes"], told["largest"], told["small"], some)

    def starts(self, kind: str) -> DataFrame:
        """(c, start): the rows of all classes sorted before each, c of type ``kind``."""
        if self.table is not None:
            return running_totals(self.table, [], "c", {"n": "start"}).select("c", "start")
        ends = accumulate((n for _, n in self.listed), initial=0)
        spark = SparkSession.active()
        return spark.createDataFrame([(c, s) for (c, _), s in zip(self.listed, ends)],
                                     f"c {kind}, start bigint")


def class_positions(df: DataFrame, label: str, row_id: str, seed: int,
                    sizes: ClassSizes | None = None,
                    bucket_rows: int = BUCKET_ROWS, out: str = "position") -> DataFrame:
    """Number rows 0..n-1 by (class, seeded random order), exactly, for any number of classes.

    The random order is a hex digest, so its leading digits are ordered buckets
    of nearly equal size however the rows are spread over classes.
    """
    sizes = ClassSizes.of(df, label) if sizes is None else sizes
    digits = max(0, math.ceil(math.log(max(1, sizes.largest / bucket_rows), 16)))
    keyed = df.withColumn("__h", order_key(seed, col(row_id)))
    keyed = keyed.withColumn("__b", F.substring("__h", 1, digits))
    if digits == 0 and sizes.listed is not None:
        ends = accumulate((n for _, n in sizes.listed), initial=0)
        pairs = [x for (v, _), s in zip(sizes.listed, ends) for x in (F.lit(v), F.lit(s).cast("bigint"))]
        first = F.element_at(F.create_map(*pairs), col(label)) if pairs else F.lit(0)
        keyed = keyed.withColumn("__start", first)
    else:
        # One row per (class, bucket): a small table beside the rows.
        per_bucket = keyed.groupBy(col(label).alias("__l"), col("__b").alias("__k")).count()
        before = (Window.partitionBy("__l").orderBy("__k")
                  .rowsBetween(Window.unboundedPreceding, -1))
        classes = sizes.starts(df.schema[label].dataType.simpleString()).select(
            F.col("c").alias("__c"), F.col("start").alias("__s"))
        offsets = (per_bucket
                   .withColumn("__p", F.coalesce(F.sum("count").over(before), F.lit(0)))
                   .join(classes, F.col("__l") == F.col("__c"))
                   .select("__l", "__k", (F.col("__p") + F.col("__s")).alias("__start")))
        # Merged, never broadcast: the files of the rows may look small to the planner. The
        # numbering below deals the rows by the same keys.
        offsets = offsets.hint("merge")
        keyed = keyed.join(offsets, (col(label) == F.col("__l")) & (F.col("__b") == F.col("__k")))
        keyed = keyed.drop("__l", "__k")
    in_bucket = Window.partitionBy(col(label), "__b").orderBy("__h", col(row_id))
    numbered = keyed.withColumn(
        out, F.col("__start") + F.row_number().over(in_bucket).cast("bigint") - F.lit(1))
    return numbered.drop("__h", "__b", "__start")


def running_totals(df: DataFrame, groups: Sequence[str], order: str,
                   totals: dict[str, str]) -> DataFrame:
    """For each row the sum of earlier rows' values, per group, in ``order``.

    ``df`` holds one row per (group, order value); ``totals`` maps a column to
    the name of its running sum, which excludes the row itself. Nulls come
    first, as in any ascending order. The rows are dealt by ranges of the column
    itself and written down; sums inside a range are added to those of the
    ranges before it. Any ranges give the same sums, so one way serves all sizes.
    """
    path = scratch_dir(df.sparkSession, "totals")
    (df.repartitionByRange(col(order)).withColumn("__part", F.spark_partition_id())
     .write.parquet(path))
    ranged = df.sparkSession.read.parquet(path)
    keys = [col(g) for g in groups]
    per_part = ranged.groupBy(*keys, "__part").agg(*[F.sum(col(c)).alias(c) for c in totals])
    before = (Window.partitionBy(*keys).orderBy("__part")
              .rowsBetween(Window.unboundedPreceding, -1))
    # One row for each (group, range).
    starts = per_part.select(
        *[col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__k"),
        *[F.coalesce(F.sum(col(c)).over(before), F.lit(0)).alias(f"__s_{n}")
          for c, n in totals.items()])
    same = F.col("__part") == F.col("__k")
    for i, g in enumerate(groups):
        same = same & col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = (Window.partitionBy(*keys, "__part").orderBy(col(order))
              .rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(starts, same).select(
        *[col(c) for c in df.columns],
        *[(col(f"__s_{n}") + F.coalesce(F.sum(col(c)).over(inside), F.lit(0))).alias(n)
          for c, n in totals.items()])


@dataclass
class _Middle:
    """What is known about the middle of one series: it lies in (low, high)."""

    n: int
    inside: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf
    answer: float | None = None

    @property
    def ranks(self) -> tuple[int, int]:
        return (self.n - 1) // 2, self.n // 2

    def within(self, value: Column) -> Column:
        if self.low == -math.inf and self.high == math.inf:
            return value
        return F.when((value > F.lit(self.low)) & (value < F.lit(self.high)), value)

    def marks(self, accuracy: int) -> list[float]:
        first, last = self.ranks
        slack = 2.0 / accuracy
        return [max(0.0, (first - self.below) / self.inside - slack),
                min(1.0, (last - self.below + 1) / self.inside + slack)]

    def _widen(self, lower: bool, low: float, high: float, at_low: int, end: int) -> None:
        """The middle lies outside the guessed bracket, on the side told."""
        if lower:
            self.high, self.inside = low, at_low - self.below
        else:
            self.inside = self.below + self.inside - end
            self.low, self.below = high, end

    def learn(self, low: float, high: float, seen: Row, tag: str) -> None:
        """Use exact counts around a guessed bracket [low, high]."""
        at_low = seen[f"b{tag}"]
        inner = at_low + seen[f"l{tag}"]
        at_high = inner + seen[f"s{tag}"]
        end = at_high + seen[f"h{tag}"]
        known = []
        for rank in self.ranks:
            if rank < at_low or rank >= end:
                # The sketch missed: go on beyond its bracket, whose counts are exact.
                self._widen(rank < at_low, low, high, at_low, end)
                return
            if rank < inner:
                known.append(low)
            elif rank >= at_high:
                known.append(high)
            elif rank == inner:
                known.append(seen[f"f{tag}"])
            elif rank == at_high - 1:
                known.append(seen[f"t{tag}"])
        if len(known) == 2:
            self.answer = sum(known) / 2
        self.low, self.high, self.below, self.inside = low, high, inner, at_high - inner


def exact_medians(df: DataFrame, columns: dict[str, Column],
                  masks: dict[Hashable, Column] | None = None, limit: int = 1_000_000,
                  accuracy: int = 10_000) -> dict[tuple[Hashable, str], float | None]:
    """Exact median of each column over the rows of each mask, by (mask, column).

    A sketch brackets the middle, counts prove the bracket, and the open
    interval shrinks about ``accuracy``-fold per pass until few values are
    left, so memory per task is bounded whatever the number of distinct values.
    """
    masks = {None: F.lit(True)} if masks is None else masks
    names = [(m, c) for m in masks for c in columns]
    if len(names) > SERIES_PER_JOB and len(masks) > 1:
        half = len(masks) // 2
        parts = (dict(list(masks.items())[:half]), dict(list(masks.items())[half:]))
        return {k: v for part in parts
                for k, v in exact_medians(df, columns, part, limit, accuracy).items()}
    plain = {c: v.cast("double") for c, v in columns.items()}
    values = {(m, c): F.when(masks[m], plain[c]) for m, c in names}
    first = df.agg(*[F.count(values[n]).alias(f"n{i}") for i, n in enumerate(names)]).first()
    state = {n: _Middle(first[f"n{i}"], first[f"n{i}"]) for i, n in enumerate(names)}
    open_names = [n for n in names if state[n].n > 0]
    while True:
        wide = [n for n in open_names if state[n].answer is None and state[n].inside > limit]
        if not wide:
            break
        guesses = df.agg(*[
            F.percentile_approx(state[n].within(values[n]), state[n].marks(accuracy), accuracy)
            .alias(f"q{i}") for i, n in enumerate(wide)]).first()
        checks = []
        for i, n in enumerate(wide):
            low, high = [F.lit(x) for x in guesses[f"q{i}"]]
            v = values[n]
            strict = F.when((v > low) & (v < high), v)
            at_high = (v == high) & (v > low)
            checks += [F.count_if(v < low).alias(f"b{i}"), F.count_if(v == low).alias(f"l{i}"),
                       F.count(strict).alias(f"s{i}"), F.count_if(at_high).alias(f"h{i}"),
                       F.min(strict).alias(f"f{i}"), F.max(strict).alias(f"t{i}")]
        seen = df.agg(*checks).first()
        for i, n in enumerate(wide):
            state[n].learn(*guesses[f"q{i}"], seen, str(i))
    rest = [n for n in open_names if state[n].answer is None]
    found = _middle_values(df, rest, state, plain, masks) if rest else {}
    return {n: found.get(n, state[n].answer) for n in names}


def _middle_values(df: DataFrame, names: list, state: dict, columns: dict[str, Column],
                   masks: dict[Hashable, Column]) -> dict:
    """Count the few values left, per mask, and read off the middle ranks."""
    open_columns = list(dict.fromkeys(c for _, c in names))
    keys = list(dict.fromkeys(m for m, _ in names))
    flagged = df.select(
        *[masks[m].alias(f"m{k}") for k, m in enumerate(keys)],
        F.explode(F.array(*[F.struct(F.lit(i).alias("s"), columns[c].alias("v"))
                            for i, c in enumerate(open_columns)])).alias("e"))
    long = flagged.select(*[f"m{k}" for k in range(len(keys))], "e.s", "e.v")
    hits = {n: F.col(f"m{keys.index(n[0])}") & (F.col("s") == open_columns.index(n[1]))
            & state[n].within(F.col("v")).isNotNull() for n in names}
    wanted = reduce(or_, hits.values())
    # One row per value, one count per mask: rows are not copied per mask.
    tally = long.filter(wanted).groupBy("s", "v").agg(*[
        F.count_if(hits[n]).alias(f"c{i}") for i, n in enumerate(names)])
    ranked = running_totals(tally, ["s"], "v", {f"c{i}": f"u{i}" for i in range(len(names))})
    picks = []
    for i, n in enumerate(names):
        for rank in set(state[n].ranks):
            at = rank - state[n].below
            picks.append(F.when((F.col("s") == open_columns.index(n[1]))
                                & (F.col(f"u{i}") <= at)
                                & (F.col(f"u{i}") + F.col(f"c{i}") > at), F.lit(i)))
    found: dict = {}
    chosen = ranked.select("v", F.array_compact(F.array(*picks)).alias("of"))
    for row in chosen.filter(F.size("of") > 0).collect():
        for i in set(row["of"]):
            found.setdefault(names[i], []).append(row["v"])
    return {n: sum(v) / len(v) for n, v in found.items()}
