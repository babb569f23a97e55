"""Turn categories into numbers: one-hot, ordinal and ladder encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwise.frame import Frame, col
from foldwise.operators.base import Cells, Projection, add_counts, typed, value_counts
from foldwise.operators.categories import Counted, Members, Tally
from foldwise.operators.folds import SLICE

# Names and options users of such encoders know.
NULL_NAME = "nan"
INFREQUENT_NAME = "infrequent_sklearn"
ONE_HOT_UNKNOWN = ("error", "ignore", "warn", "infrequent_if_exist")
ORDINAL_UNKNOWN = ("error", "use_encoded_value")

MAX_ONE_HOT_COLUMNS = 5_000
BITMAP_BITS = 32_768


def _or_raise(known: Column, value: Column, feature: str) -> Column:
    message = F.concat(F.lit(f"unknown category in {feature!r}: "),
                       F.coalesce(col(feature).cast("string"), F.lit(NULL_NAME)))
    return F.when(known, value).otherwise(F.raise_error(message).cast("double"))


def _is_one_of(frame: Frame, feature: str, values: list) -> Column:
    """Null-safe membership; None stands for null."""
    kind = frame.type_of(feature)
    some = [typed(v, kind) for v in values if v is not None]
    found = F.coalesce(col(feature).isin(some), F.lit(False)) if some else F.lit(False)
    return found | col(feature).isNull() if None in values else found


@dataclass(frozen=True)
class Categories:
    """The output columns of one feature: a suffix and the values behind it.

    ``known`` are all values seen in training, or a table of them if they are
    many. The column ``rest`` is for values that have no column of their own;
    with ``rest_unknown`` those never seen count among them.
    """

    known: tuple | Members
    columns: tuple[tuple[str, tuple], ...]
    rest: str | None = None
    rest_unknown: bool = False
    # Values with a column of their own, also one that was dropped.
    own: tuple = ()


def _flag(feature: str) -> str:
    return f"__known {feature}"


def _known(frame: Frame, feature: str, known: tuple | Members) -> Column:
    return (col(_flag(feature)) if isinstance(known, Members)
            else _is_one_of(frame, feature, list(known)))


def _flagged(frame: Frame, tables: dict[str, Members]) -> Frame:
    """The frame with a flag for each feature whose known values are a table."""
    df = frame.df
    for feature, members in tables.items():
        df = members.flagged(df, feature, _flag(feature))
    return frame.with_df(df)


@dataclass(frozen=True)
class FittedOneHot(Projection):
    encoded: dict[str, Categories]
    strict: bool

    @property
    def tables(self) -> dict[str, Members]:
        """Known values that are asked for and too many for an expression."""
        return {n: c.known for n, c in self.encoded.items() if isinstance(c.known, Members)
                and (self.strict or c.rest is not None and not c.rest_unknown)}

    @property
    def plain(self) -> bool:
        return not self.tables

    def apply(self, frame: Frame) -> Frame:
        return _flagged(frame, self.tables).rebuild(self.columns(frame))

    def columns(self, frame: Frame) -> dict[str, Column]:
        columns = {n: c for n, c in frame.columns().items() if n not in self.encoded}
        for feature, cats in self.encoded.items():
            outputs = [(suffix, _is_one_of(frame, feature, list(values)))
                       for suffix, values in cats.columns]
            if cats.rest is not None:
                rest = ~_is_one_of(frame, feature, list(cats.own))
                if not cats.rest_unknown:
                    rest = rest & _known(frame, feature, cats.known)
                outputs.append((cats.rest, rest))
            for suffix, hit in outputs:
                out = hit.cast("double")
                if self.strict:
                    # On each column, so that none can be read without the check.
                    out = _or_raise(_known(frame, feature, cats.known), out, feature)
                columns[f"{feature}_{suffix}"] = out
        return columns


class OneHot:
    """One 0/1 column per category, named ``feature_value``, at the end.

    Categories are those of the training rows, sorted, null one of them; or
    those given for each feature, in their order (``categories``). Features may
    be named, or found by having fewer than ``max_unique_vals`` distinct values.
    With ``min_frequency`` or ``max_categories`` there may be any number of
    categories; more than ``max_columns`` outputs are an error.
    """

    def __init__(self, features: list[str] = (), max_unique_vals: int = -1, drop=None,
                 handle_unknown: str = "error", min_frequency=None, max_categories=None,
                 max_columns: int = MAX_ONE_HOT_COLUMNS, categories="auto"):
        if handle_unknown not in ONE_HOT_UNKNOWN:
            raise ValueError(f"handle_unknown must be one of {ONE_HOT_UNKNOWN}")
        if not isinstance(max_unique_vals, int):
            raise TypeError("max_unique_vals must be an integer")
        self.features = list(features)
        self.max_unique_vals = max_unique_vals
        self.drop = drop
        self.handle_unknown = handle_unknown
        self.min_frequency = min_frequency
        self.max_categories = max_categories
        self.max_columns = max_columns
        if categories != "auto":
            if max_unique_vals != -1 or len(categories) != len(self.features):
                raise ValueError("categories need one list for each named feature")
            for feature, own in zip(self.features, categories):
                if len(set(own)) < len(own):
                    raise ValueError(f"categories of {feature!r} are given twice")
        self.categories = categories

    def names(self, frame: Frame) -> list[str]:
        names = frame.require(self.features)
        if self.max_unique_vals != -1:
            rest = [n for n in frame.features if n not in names]
            names = names + low_cardinality(frame, rest, self.max_unique_vals)
        return names

    def fit(self, frame: Frame) -> FittedOneHot:
        return self._fit(frame, self.names(frame), {None: None}, None)[None]

    def fit_cells(self, frame: Frame, cells: Cells, by: str = SLICE) -> dict:
        if self.max_unique_vals == -1:
            return self._fit(frame, frame.require(self.features), cells, by)
        # Which features are categorical differs from cell to cell.
        named = frame.require(self.features)
        rest = [n for n in frame.features if n not in named]
        found = low_cardinality_cells(frame, rest, self.max_unique_vals, cells, by)
        every = [n for n in rest if any(n in own for own in found.values())]
        fitted = self._fit(frame, [*named, *every], cells, by, {
            k: [*named, *own] for k, own in found.items()})
        return fitted

    def _fit(self, frame: Frame, names: list[str], cells: Cells, by: str | None,
             own_names: dict | None = None) -> dict:
        """One fit for each cell, of its own features among ``names`` if they are given."""
        if self.categories != "auto":
            counted = self._given(frame, names, cells, by)
        elif self.min_frequency is None and self.max_categories is None:
            counted = self._all(frame, names, cells, by)
        else:
            counted = self._frequent(frame, names, cells, by)
        out = {}
        for k in cells:
            own = names if own_names is None else own_names[k]
            encoded = {n: self._categories(i, n, *counted[n][k]) for i, n in enumerate(own)}
            width = sum(len(c.columns) + (c.rest is not None) for c in encoded.values())
            if width > self.max_columns:
                raise ValueError(f"one-hot encoding would make {width} columns; set max_categories, "
                                 f"or max_columns above {self.max_columns}")
            out[k] = FittedOneHot(encoded, self.handle_unknown == "error")
        return out

    # Each of these tells by feature and cell: values that get a column, known values,
    # and whether some known ones get none.

    def _all(self, frame: Frame, names: list[str], cells: Cells, by: str | None) -> dict:
        # A drop takes one column of a feature at most.
        parts = value_counts(frame, names, by, self.max_columns + len(names))
        out: dict = {n: {} for n in names}
        for k, slices in cells.items():
            for n, found in add_counts(parts, names, slices).items():
                values = (*found.values, None) if found.nulls else found.values
                out[n][k] = values, values, False
        return out

    def _frequent(self, frame: Frame, names: list[str], cells: Cells, by: str | None) -> dict:
        most = self.max_columns + 1 if self.max_categories is None else self.max_categories
        out: dict = {}
        for n in names:
            tally = Tally(frame, n, cells, by)
            out[n] = {}
            for k, found in tally.most_frequent(most, self.min_frequency).items():
                values = self._kept(found)
                out[n][k] = values, tally.known(k), len(values) < found.distinct
        return out

    def _kept(self, found: Counted) -> tuple:
        """The values that get a column of their own."""
        outputs = found.frequent + (found.frequent < found.distinct)
        if self.max_categories is None or self.max_categories >= outputs:
            return found.values
        place = {v: i for i, v in enumerate(found.values)}
        # Of equal counts the later category counts as more frequent.
        ranked = sorted(zip(found.counts, found.values), key=lambda e: (e[0], place[e[1]]))
        kept = {v for _, v in ranked[len(ranked) - (self.max_categories - 1):]}
        return tuple(v for v in found.values if v in kept)

    def _given(self, frame: Frame, names: list[str], cells: Cells, by: str | None) -> dict:
        """The declared categories; with ``error`` the training rows must hold no others."""
        declared = {n: tuple(_nan_is_none(v) for v in own) for n, own in zip(names, self.categories)}
        out: dict = {n: {} for n in names}
        for n, values in declared.items():
            some = [v for v in values if v is not None]
            if not all(isinstance(v, str) for v in some) and some != sorted(some):
                raise ValueError(f"numeric categories of {n!r} must be sorted")
            if self.min_frequency is None and self.max_categories is None:
                if self.handle_unknown == "error":
                    self._check_given(frame, n, values)
                out[n] = {k: (values, values, False) for k in cells}
                continue
            tally = Tally(frame, n, cells, by)
            for k, found in tally.among(some).items():
                counts = dict(zip(found.values, found.counts))
                out[n][k] = (*self._kept_given(values, counts, found.rows), )
        return out

    @staticmethod
    def _check_given(frame: Frame, feature: str, values: tuple) -> None:
        other = frame.df.where(~_is_one_of(frame, feature, list(values))).select(col(feature)).first()
        if other is not None:
            raise ValueError(f"unknown category in {feature!r}: {other[0]!r}")

    def _kept_given(self, values: tuple, counts: dict, rows: int) -> tuple:
        """Declared values by their counts in the training rows; some have none."""
        n = [counts.get(v, 0) for v in values]
        least = self.min_frequency
        if isinstance(least, float):
            least = least * rows
        kept = [i for i in range(len(values)) if least is None or n[i] >= least]
        outputs = len(kept) + (len(kept) < len(values))
        if self.max_categories is not None and self.max_categories < outputs:
            kept = sorted(kept, key=lambda i: (n[i], i))[len(kept) - (self.max_categories - 1):]
        return tuple(values[i] for i in sorted(kept)), values, len(kept) < len(values)

    def _categories(self, place: int, feature: str, values: tuple, known: tuple | Members,
                    rare: bool) -> Categories:
        columns = [(NULL_NAME if v is None else str(v), (v,)) for v in values]
        rest = INFREQUENT_NAME if rare else None
        outputs = columns + ([(INFREQUENT_NAME, None)] if rare else [])
        gone = self._dropped(place, feature, outputs, known)
        if gone == len(columns):
            rest = None
        columns = [c for i, c in enumerate(columns) if i != gone]
        to_rest = rare and self.handle_unknown in ("warn", "infrequent_if_exist")
        return Categories(known, tuple(columns), rest, to_rest, values)

    def _dropped(self, place: int, feature: str, columns: list, known) -> int | None:
        if self.drop is None or not columns:
            return None
        if self.drop == "first":
            return 0
        if self.drop == "if_binary":
            return 0 if len(columns) == 2 else None
        wanted = self.drop[place]
        for i, (_, values) in enumerate(columns):
            if wanted in (values or ()):
                return i
        if columns[-1][1] is None and not isinstance(known, Members) and wanted in known:
            return len(columns) - 1
        raise ValueError(f"category to drop not found in {feature!r}: {wanted!r}")


def low_cardinality(frame: Frame, names: list[str], below: int) -> list[str]:
    """The features with fewer than ``below`` distinct non-null values, exactly.

    A bitmap of hashed values cannot hold more bits than there are values, so
    it proves in one pass, in 4 KiB per feature, which features have too many.
    Only the rest is counted exactly, and that is cheap: it has few values.
    """
    if not names:
        return []
    candidates = names
    if below <= BITMAP_BITS // 2:
        # A null position sets no bit.
        bits = frame.df.agg(*[
            F.bitmap_count(F.bitmap_construct_agg(
                F.when(col(n).isNotNull(), F.pmod(F.xxhash64(col(n)), F.lit(BITMAP_BITS)))))
            .alias(f"b{i}") for i, n in enumerate(names)]).first()
        candidates = [n for i, n in enumerate(names) if bits[f"b{i}"] < below]
    if not candidates:
        return []
    exact = frame.df.agg(*[F.count_distinct(col(n)).alias(f"d{i}")
                           for i, n in enumerate(candidates)]).first()
    return [n for i, n in enumerate(candidates) if exact[f"d{i}"] < below]


def low_cardinality_cells(frame: Frame, names: list[str], below: int, cells: Cells,
                          by: str = SLICE) -> dict:
    """For each cell its features with fewer than ``below`` distinct values, in two jobs.

    Every slice makes one bitmap a feature; the bitmaps of a cell's slices are
    joined on the driver (4 KiB each) and rule features out as above. What is
    left has few values in some cell: those are counted by slice, exactly.
    """
    if not names:
        return {k: [] for k in cells}
    candidates = {k: set(names) for k in cells}
    if below <= BITMAP_BITS // 2:
        rows = frame.df.groupBy(col(by).alias("s")).agg(*[
            F.bitmap_construct_agg(F.when(col(n).isNotNull(),
                                          F.pmod(F.xxhash64(col(n)), F.lit(BITMAP_BITS)))).alias(f"b{i}")
            for i, n in enumerate(names)]).collect()
        bits = {r["s"]: [int.from_bytes(r[f"b{i}"], "little") for i in range(len(names))] for r in rows}
        for k, slices in cells.items():
            for i, n in enumerate(names):
                joined = 0
                for s in slices:
                    joined |= bits[s][i] if s in bits else 0
                if joined.bit_count() >= below:
                    candidates[k].discard(n)
    left = [n for n in names if any(n in own for own in candidates.values())]
    if not left:
        return {k: [] for k in cells}
    long = frame.df.select(col(by).alias("s"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.xxhash64(col(n)).alias("h"), col(n).cast("string").alias("v"))
        for i, n in enumerate(left)])).alias("e")).where(F.col("e.v").isNotNull())
    seen = long.groupBy("e.f", "e.h", "e.v").agg(F.collect_set("s").alias("slices"))
    counted = seen.groupBy("f").agg(*[F.count_if(F.arrays_overlap("slices", F.array(*map(F.lit, s))))
                                      .alias(f"c{j}") for j, s in enumerate(cells.values())]).collect()
    distinct = {left[r["f"]]: r for r in counted}
    return {k: [n for n in left if n in candidates[k]
                and (distinct[n][f"c{j}"] if n in distinct else 0) < below]
            for j, k in enumerate(cells)}


@dataclass(frozen=True)
class FittedOrdinal(Projection):
    codes: dict[str, tuple]
    strict: bool
    unknown_value: float | None
    missing_value: float | None

    def columns(self, frame: Frame) -> dict[str, Column]:
        columns = frame.columns()
        for feature, order in self.codes.items():
            kind = frame.type_of(feature)
            code = F.lit(None).cast("double")
            for i, value in reversed(list(enumerate(order))):
                code = F.when(col(feature) == typed(value, kind), F.lit(float(i))).otherwise(code)
            known = _is_one_of(frame, feature, list(order))
            other = (_or_raise(known, code, feature) if self.strict
                     else F.when(known, code).otherwise(F.lit(self.unknown_value).cast("double")))
            columns[feature] = (F.when(col(feature).isNull(),
                                       F.lit(self.missing_value).cast("double"))
                                .otherwise(other))
        return columns


class Ordinal:
    """Replace a category by its place in a declared order; nulls stay null.

    Features keep their place, on the training and on the test side alike.
    """

    def __init__(self, features: list[str], categories: list, handle_unknown: str = "error",
                 unknown_value: float | None = None, encoded_missing_value: float | None = None):
        if not isinstance(categories, (list, tuple)):
            raise TypeError("categories must be a list")
        if categories and not isinstance(categories[0], (list, tuple)):
            categories = [categories]
        if len(categories) != len(features):
            raise ValueError("one list of categories per feature is needed")
        if handle_unknown not in ORDINAL_UNKNOWN:
            raise ValueError(f"handle_unknown must be one of {ORDINAL_UNKNOWN}")
        self.features = list(features)
        self.categories = [tuple(c) for c in categories]
        self.handle_unknown = handle_unknown
        self.unknown_value = _nan_is_none(unknown_value)
        self.encoded_missing_value = _nan_is_none(encoded_missing_value)

    def fit(self, frame: Frame) -> FittedOrdinal:
        names = frame.require(self.features)
        return FittedOrdinal(dict(zip(names, self.categories)), self.handle_unknown == "error",
                             self.unknown_value, self.encoded_missing_value)

    def fit_cells(self, frame: Frame, cells: Cells, by: str = SLICE) -> dict:
        fitted = self.fit(frame)
        return {k: fitted for k in cells}


def _nan_is_none(value):
    return None if value is not None and value != value else value


@dataclass(frozen=True)
class FittedLadder(Projection):
    feature: str
    groups: tuple[tuple, ...]
    seen: tuple | Members
    strict: bool

    @property
    def plain(self) -> bool:
        return not (self.strict and isinstance(self.seen, Members))

    def apply(self, frame: Frame) -> Frame:
        tables = {} if self.plain else {self.feature: self.seen}
        return _flagged(frame, tables).rebuild(self.columns(frame))

    def columns(self, frame: Frame) -> dict[str, Column]:
        columns = {n: c for n, c in frame.columns().items() if n != self.feature}
        labels = ["|".join(str(v) for v in g) for g in self.groups]
        for rung in range(1, len(self.groups)):
            at_least = [v for g in self.groups[rung:] for v in g]
            step = _is_one_of(frame, self.feature, at_least).cast("int")
            if self.strict:
                known = _known(frame, self.feature, self.seen) | col(self.feature).isNull()
                step = _or_raise(known, step, self.feature).cast("int")
            columns[f"{self.feature} ({labels[rung - 1]} <- {labels[rung]})"] = step
        return columns


class Ladder:
    """One 0/1 column per step up an ordered category.

    Neighbouring values are pooled until a rung holds ``min_frequency`` of the
    training rows; a value has a 1 for each rung at or below its own. Nulls and
    values outside the order stand on the ground.
    """

    def __init__(self, feature: str, order: list, min_frequency: float = 0.0,
                 handle_unknown: str = "error", sparse_output=None):
        if not isinstance(order, list) or len(order) < 2:
            raise ValueError("order must be a list of at least 2 values")
        if not isinstance(min_frequency, float):
            raise TypeError("min_frequency must be a float")
        if sparse_output is not None:
            raise ValueError("sparse_output is not an option here")
        if handle_unknown not in ONE_HOT_UNKNOWN:
            raise ValueError(f"handle_unknown must be one of {ONE_HOT_UNKNOWN}")
        self.feature = feature
        self.order = order
        self.min_frequency = min_frequency
        self.handle_unknown = handle_unknown

    def fit(self, frame: Frame) -> FittedLadder:
        return self._fit(frame, {None: None}, None)[None]

    def fit_cells(self, frame: Frame, cells: Cells, by: str = SLICE) -> dict:
        return self._fit(frame, cells, by)

    def _fit(self, frame: Frame, cells: Cells, by: str | None) -> dict:
        tally = Tally(frame, *frame.require([self.feature]), cells, by)
        return {k: self._groups(found, tally, k) for k, found in tally.among(self.order).items()}

    def _groups(self, found: Counted, tally: Tally, key) -> FittedLadder:
        rows = dict(zip(found.values, found.counts))
        needed = self.min_frequency * found.rows
        groups: list[list] = []
        pool: list = []
        for value in (v for v in self.order if v in rows):
            pool.append(value)
            if sum(rows[v] for v in pool) >= needed:
                groups.append(pool)
                pool = []
        if pool and not groups:
            raise ValueError(f"no rung of {self.feature!r} reaches min_frequency")
        if pool:
            groups[-1].extend(pool)
        strict = self.handle_unknown == "error"
        return FittedLadder(self.feature, tuple(tuple(g) for g in groups),
                            tally.known(key) if strict else (), strict)
