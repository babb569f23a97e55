"""Exact k nearest neighbours without comparing every pair on one machine.

A training set of proven small size is broadcast. A larger one is routed:

1. A few rows become pivots; every row goes to the cell of its nearest pivot.
2. From the k rows nearest to each pivot follows, by the triangle inequality, a
   radius for each test cell within which k neighbours must exist.
3. A training row is sent to the test cells whose radius reaches it (Lu et al.,
   2012), and to no other. All true neighbours meet their test row.
4. Cells are cut into blocks of bounded size on both sides. A task compares one
   test block with one training block and emits k rows per test row.

Test cells that more than half of the training rows reach share blocks, which meet all
training rows: a training row is sent once a block of test rows, not once a cell.

Nothing is dropped: a row that cannot be ruled out is always compared. With p = 2 one
matrix product in single precision bounds all distances of two blocks; only rows that
the bounds leave open are measured exactly (``_Screen``). In many dimensions little can
be ruled out; then ``recall`` opts for hashing instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.frame import Frame, col
from foldwise.functions.hashing import order_key
from foldwise.functions.ordered import class_counts
from foldwise.functions.vectors import class_index, feature_array, first_largest
from foldwise.models import lsh
from foldwise.models.base import as_trained, predictions
from foldwise.session import scratch_dir

BROADCAST_BYTES = 64 * 2**20
MAX_PIVOTS = 512
# Stands for all cells that more than half of the training rows reach.
OPEN = -1
TEST_BLOCK = 2_000
TRAIN_BLOCK = 20_000
# Bytes of a block of rows in cells that most training rows reach; at least as many rows
# as above.
TEST_BYTES, TRAIN_BYTES = 8 * 2**20, 32 * 2**20
# Pairs of rows that a task compares where training rows are broadcast.
TASK_PAIRS = 100_000_000
# Bytes of a difference tensor held at once, and of bounds.
_CHUNK = 16 * 2**20
_BOUNDS = 32 * 2**20
# Training rows whose least bound is looked at first, and rows too few to bound.
_GROUP, _FEW = 32, 1_024
# Beyond all bounds.
_UNMET = np.float32(1e37)
# Pairs measured at once for rows that meet in buckets.
_PAIRS = 500_000
# Distances are ranked after rounding, so that equal ones tie everywhere.
RANK_DIGITS = 9


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances between the rows of a and of b, in bounded memory."""
    out = np.empty((len(a), len(b)))
    step = max(1, _CHUNK // max(1, 8 * b.size))
    for i in range(0, len(a), step):
        out[i:i + step] = _lengths(a[i:i + step, None, :] - b[None, :, :], p)
    return out


def _lengths(gap: np.ndarray, p: float) -> np.ndarray:
    if p == 2:
        return np.sqrt((gap * gap).sum(axis=-1))
    gap = np.abs(gap)
    return gap.sum(axis=-1) if p == 1 else (gap**p).sum(axis=-1) ** (1.0 / p)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float, copy=False)


@dataclass(frozen=True)
class _Screen:
    """Training rows in single precision, around their mean and divided by the largest norm.

    One matrix product gives the squared distances to some test rows up to a proven
    error. Rows beyond the k-th least by more than that are no neighbours.
    """

    centre: np.ndarray
    size: float
    # What rounding of the rows themselves can change in a coordinate.
    blur: float
    # By row -2 x and |x|^2, so that a product with (t, 1) is the squared distance less |t|^2.
    wide: np.ndarray
    rows: int

    @staticmethod
    def of(x: np.ndarray) -> "_Screen | None":
        """None if bounds would not hold or not pay."""
        if len(x) < _FEW or not np.isfinite(x).all():
            return None
        with np.errstate(over="ignore", invalid="ignore"):
            centre = x.mean(axis=0)
            y = x - centre
            size = float(np.sqrt(np.einsum("ij,ij->i", y, y).max()))
        if not 1e-100 < size < 1e100:
            return None
        y /= size
        wide = np.zeros((-(-len(x) // _GROUP) * _GROUP, x.shape[1] + 1), dtype=np.float32)
        np.multiply(y, -2, out=wide[:len(x), :-1], casting="same_kind")
        wide[:len(x), -1] = np.einsum("ij,ij->i", y, y)
        wide[len(x):, -1] = np.inf
        return _Screen(centre, size, 2.0**-51 * float(np.abs(x).max()) / size, wide, len(x))

    def pairs(self, tests: np.ndarray, k: int, met: np.ndarray | None = None
              ) -> tuple[np.ndarray, np.ndarray] | None:
        """(test row, training row) of all that may be neighbours, in this order; None if the
        bounds leave too much open. Only pairs marked in ``met``, by training row, if given."""
        groups, d = len(self.wide) // _GROUP, tests.shape[1]
        if groups < k:
            return None
        with np.errstate(over="ignore", invalid="ignore"):
            a = (tests - self.centre) / self.size
            norm = (a * a).sum(axis=1)
        if not norm.max() < 1e30:
            return None
        blur = self.blur + 2.0**-51 * float(np.abs(tests).max()) / self.size
        error = (2.0**-23 * (d + 8) + 16 * d * blur) * (norm + 1) + d * blur * blur
        wide = np.ones((len(a), d + 1), dtype=np.float32)
        wide[:, :-1] = a
        near = self.wide @ wide.T
        if met is not None:
            for i in range(0, self.rows, _FEW):
                near[i:i + _FEW][:len(met[i:i + _FEW])] += _UNMET * ~met[i:i + _FEW]
        # Least bound of each group of rows that stand ``groups`` apart.
        least = np.ascontiguousarray(near.reshape(_GROUP, groups, len(a)).min(axis=0).T)
        kth = np.partition(least, k - 1, axis=1)[:, k - 1] + norm
        # Distances that round alike rank by id.
        far = np.sqrt(np.maximum(kth, 0.0) + error) * (1 + 1e-12) + 2 * 10.0**-RANK_DIGITS / self.size
        limit = np.nextafter((far * far + error - norm).astype(np.float32), np.float32(np.inf))
        at, group = np.nonzero(least <= limit[:, None])
        if len(at) * _GROUP > max(near.size // 8, 64 * k * len(a)):
            return None
        columns = group[:, None] + groups * np.arange(_GROUP)
        open_ = near[columns, at[:, None]]
        kept = open_ <= limit[at][:, None]
        if met is not None:
            # A row that meets fewer than k has no limit.
            kept &= open_ < _UNMET / 2
        at, columns = np.broadcast_to(at[:, None], kept.shape)[kept], columns[kept]
        order = np.lexsort((columns, at))
        return at[order], columns[order]


@dataclass(frozen=True)
class _Block:
    """Training rows in order of their id."""

    x: np.ndarray
    ids: np.ndarray
    classes: np.ndarray

    @cached_property
    def screen(self) -> _Screen | None:
        return _Screen.of(self.x)

    @staticmethod
    def of(rows: pd.DataFrame) -> "_Block":
        rows = rows.sort_values("o")
        return _Block(_matrix(rows["x"]), rows["o"].to_numpy(), rows["c"].to_numpy())

    def nearest(self, tests: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and places of the k nearest of each test row; ties by id."""
        m = min(k, len(self.x))
        d, best = np.empty((len(tests), m)), np.empty((len(tests), m), dtype=int)
        screen = self.screen if p == 2 and len(tests) and np.isfinite(tests).all() else None
        bytes_a_row = 4 * len(screen.wide) if screen else 8 * len(self.x)
        step = max(1, (_BOUNDS if screen else _CHUNK) // max(1, bytes_a_row))
        for i in range(0, len(tests), step):
            some = slice(i, i + step)
            pairs = screen.pairs(tests[some], k) if screen else None
            d[some], best[some] = (self._all(tests[some], m, p) if pairs is None
                                   else self._some(tests[some], m, *pairs))
        return d, best

    def _all(self, tests: np.ndarray, m: int, p: float) -> tuple[np.ndarray, np.ndarray]:
        d, best = np.empty((len(tests), m)), np.empty((len(tests), m), dtype=int)
        step = max(1, _CHUNK // max(1, 8 * len(self.x)))
        for i in range(0, len(tests), step):
            every = distances(tests[i:i + step], self.x, p)
            # Ids ascend, so a stable sort breaks ties by id.
            order = np.argsort(np.round(every, RANK_DIGITS), axis=1, kind="stable")[:, :m]
            best[i:i + step] = order
            d[i:i + step] = np.take_along_axis(every, order, axis=1)
        return d, best

    def _some(self, tests: np.ndarray, m: int, at: np.ndarray, columns: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
        """The nearest among the given pairs, which hold at least m of each test row."""
        every = self._between(tests, at, columns, 2)
        order = np.lexsort((columns, np.round(every, RANK_DIGITS), at))
        first = np.searchsorted(at, np.arange(len(tests)))
        picked = order[first[:, None] + np.arange(m)]
        return every[picked], columns[picked]

    def _between(self, tests: np.ndarray, at: np.ndarray, columns: np.ndarray, p: float) -> np.ndarray:
        every = np.empty(len(at))
        step = max(1, _CHUNK // (8 * tests.shape[1]))
        for i in range(0, len(at), step):
            every[i:i + step] = _lengths(tests[at[i:i + step]] - self.x[columns[i:i + step]], p)
        return every

    def _met(self, tests: np.ndarray, met: np.ndarray, k: int, p: float
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test row, distance, place) of the k nearest that each test row meets, or of all; what
        meets is marked by training row and test row."""
        n = np.count_nonzero(met)
        screen = self.screen if p == 2 and n > met.size // 64 and np.isfinite(tests).all() else None
        pairs = screen.pairs(tests, k, met) if screen else None
        if pairs is None and n > _PAIRS and len(tests) > 1:
            half = len(tests) // 2
            a, b = (self._met(tests[s], met[:, s], k, p) for s in (slice(half), slice(half, None)))
            return np.concatenate([a[0], b[0] + half]), *map(np.concatenate, zip(a[1:], b[1:]))
        at, columns = np.nonzero(met.T) if pairs is None else pairs
        every = self._between(tests, at, columns, p)
        order = np.lexsort((columns, np.round(every, RANK_DIGITS), at))
        # Pairs stand by test row, before and after.
        order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
        return at[order], every[order], columns[order]

    def met_rows(self, tests: pd.DataFrame, k: int, p: float, hashes: lsh.Hashes) -> pd.DataFrame:
        """As ``rows``, among the training rows that share a bucket with a test row."""
        x, shelf, parts = _matrix(tests["x"]), lsh.Shelf(hashes, self.x), []
        step = max(1, _BOUNDS // max(4 * len(self.x), 8 * hashes.tables * hashes.probes))
        # Bits are held in words.
        step = max(64, step // 64 * 64)
        for i in range(0, len(x), step):
            at, d, best = self._met(x[i:i + step], shelf.met(x[i:i + step]), k, p)
            parts.append((at + i, d, best))
        at, d, best = map(np.concatenate, zip(*parts))
        return pd.DataFrame({"t": tests["t"].to_numpy()[at], "d": d, "o": self.ids[best],
                             "c": self.classes[best]})

    def rows(self, tests: pd.DataFrame, k: int, p: float) -> pd.DataFrame:
        """(t, d, o, c): one row per test row and neighbour."""
        if len(tests) == 0:
            return pd.DataFrame({"t": [], "d": [], "o": [], "c": []})
        d, best = self.nearest(_matrix(tests["x"]), k, p)
        flat = best.ravel()
        return pd.DataFrame({"t": np.repeat(tests["t"].to_numpy(), best.shape[1]),
                             "d": d.ravel(), "o": self.ids[flat], "c": self.classes[flat]})


def _shares(d: np.ndarray, classes: np.ndarray, n_classes: int, by_distance: bool) -> np.ndarray:
    """Class shares among the neighbours; identical rows outvote all others."""
    weight = np.ones_like(d)
    if by_distance:
        same = d == 0
        with np.errstate(divide="ignore"):
            weight = np.where(same.any(axis=1, keepdims=True), same, 1.0 / d)
    votes = np.stack([(weight * (classes == i)).sum(axis=1) for i in range(n_classes)], axis=1)
    return votes / votes.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class FittedNeighbors:
    train: Frame
    classes: tuple
    rows: int
    k: int
    p: float
    by_distance: bool
    # The training rows, if they are proven to be few.
    held: Broadcast | None
    # Only with a recall below 1, if hashing reaches it.
    hashes: lsh.Hashes | None = None

    def neighbors(self, frame: Frame) -> DataFrame:
        """(t, d, o, c): for each test row id the k nearest training rows."""
        frame = as_trained(frame, self.train.features)
        tests = frame.df.select(col(frame.row_id).alias("t"), feature_array(frame).alias("x"))
        train = _training_rows(self.train, self.classes)
        kinds = (tests.schema["t"].dataType.simpleString(),
                 train.schema["o"].dataType.simpleString())
        schema = f"t {kinds[0]}, d double, o {kinds[1]}, c int"
        if self.hashes is not None:
            return self._hashed(train, tests, schema)
        if self.held is None:
            return self._routed(train, tests, schema)
        held, k, p = self.held, self.k, self.p

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield held.value.rows(batch, k, p)

        return self._dealt(tests).mapInPandas(match, schema)

    def _dealt(self, tests: DataFrame) -> DataFrame:
        """The test rows in as many tasks as the comparisons ask for."""
        tasks = math.ceil(tests.count() * self.rows / TASK_PAIRS)
        return tests.repartition(tasks) if tasks > 1 else tests

    def _hashed(self, train: DataFrame, tests: DataFrame, schema: str) -> DataFrame:
        """The k nearest among the rows that share a bucket; exactly for rows that find few."""
        k, p, hashes = self.k, self.p, self.hashes

        def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if len(a) == 0 or len(b) == 0:
                return pd.DataFrame({"t": [], "d": [], "o": [], "c": []})
            return _Block.of(b).met_rows(a, k, p, hashes)

        width = 8 * max(1, self.train.n_features)
        met = lsh.candidates(train, tests, match, (TEST_BYTES // width, TRAIN_BYTES // width),
                             self.rows, schema)
        order = Window.partitionBy("t").orderBy(F.round("d", RANK_DIGITS), "o")
        best = (met.withColumn("n", F.row_number().over(order))
                .filter(F.col("n") <= k).drop("n"))
        path = scratch_dir(train.sparkSession, "neighbors")
        best.write.parquet(path)
        best = train.sparkSession.read.schema(schema).parquet(path)
        full = best.groupBy("t").count().where(F.col("count") >= k)
        rest = tests.join(full, "t", "left_anti")
        if rest.isEmpty():
            return best
        return best.join(full, "t", "left_semi").unionByName(self._routed(train, rest, schema))

    def _routed(self, train: DataFrame, tests: DataFrame, schema: str) -> DataFrame:
        k, p = self.k, self.p
        # Below p = 1 the triangle inequality fails: one pivot, no pruning.
        n_pivots = min(MAX_PIVOTS, 1 + math.isqrt(self.rows) // 4) if p >= 1 else 1
        chosen = (train.select("x", order_key(0, F.col("o")).alias("h"))
                  .orderBy("h").limit(n_pivots).toPandas())
        pivots = _matrix(chosen["x"])

        @F.pandas_udf("array<double>")
        def to_pivots(xs: pd.Series) -> pd.Series:
            return pd.Series(list(distances(_matrix(xs), pivots, p))) if len(xs) else xs

        def located(df: DataFrame) -> DataFrame:
            df = df.withColumn("pd", to_pivots("x"))
            return (df.withColumn("cell", first_largest(F.transform("pd", lambda d: -d)).cast("int"))
                    .withColumn("r", F.array_min("pd")))

        tests, train = located(tests), located(train)
        radius = {r["cell"]: (r["n"], r["u"]) for r in tests.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("r").alias("u")).collect()}
        per_cell = Window.partitionBy("cell").orderBy("r", "o")
        close = (train.select("cell", "r", "o").withColumn("n", F.row_number().over(per_cell))
                 .filter(F.col("n") <= k).select("cell", "r").collect())
        reach = self._reach(pivots, radius, close)

        def reached(cells: dict[int, float]) -> Column:
            """The test cells whose reach covers a training row."""
            if not cells:
                return F.array().cast("array<int>")
            wanted = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(limit).alias("limit"))
                               for i, limit in cells.items()])
            return F.transform(
                F.filter(wanted, lambda w: F.element_at(F.col("pd"), w["cell"] + 1) <= w["limit"]),
                lambda w: w["cell"])

        load = {r["cell"]: r["count"] for r in train.select(F.explode(reached(reach)).alias("cell"))
                .groupBy("cell").count().collect()}
        open_cells = [i for i in radius if 2 * load[i] > self.rows]
        blocks = {i: (math.ceil(radius[i][0] / TEST_BLOCK), math.ceil(load[i] / TRAIN_BLOCK))
                  for i in radius if i not in open_cells}
        hits = reached({i: limit for i, limit in reach.items() if i in blocks})
        if open_cells:
            # Cells that little can be kept from meet all training rows together.
            width = 8 * max(1, pivots.shape[1])
            blocks[OPEN] = (
                math.ceil(sum(radius[i][0] for i in open_cells) / max(TEST_BLOCK, TEST_BYTES // width)),
                math.ceil(self.rows / max(TRAIN_BLOCK, TRAIN_BYTES // width)))
            hits = F.concat(F.array(F.lit(OPEN)), hits)
            tests = tests.withColumn("cell", F.when(F.col("cell").isin(open_cells), F.lit(OPEN))
                                     .otherwise(F.col("cell")))
        sent = train.select("o", "c", "x", F.explode(hits).alias("cell"))
        n_test, n_train = (self._lookup({i: b[side] for i, b in blocks.items()})
                           for side in (0, 1))

        def own(column: str, n: Column) -> Column:
            return F.pmod(F.xxhash64(column), n).cast("int")

        def all_of(n: Column) -> Column:
            return F.explode(F.sequence(F.lit(0), n - 1))

        left = tests.select("t", "x", "cell", own("t", n_test).alias("tb"),
                            all_of(n_train).alias("sb"))
        right = sent.select("o", "c", "x", "cell", own("o", n_train).alias("sb"),
                            all_of(n_test).alias("tb"))

        def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if len(a) == 0 or len(b) == 0:
                return pd.DataFrame({"t": [], "d": [], "o": [], "c": []})
            return _Block.of(b).rows(a, k, p)

        found = (left.groupBy("cell", "tb", "sb").cogroup(right.groupBy("cell", "tb", "sb"))
                 .applyInPandas(match, schema))
        # At most k rows per training block are left for each test row.
        order = Window.partitionBy("t").orderBy(F.round("d", RANK_DIGITS), "o")
        return (found.withColumn("n", F.row_number().over(order))
                .filter(F.col("n") <= k).drop("n"))

    def _reach(self, pivots: np.ndarray, radius: dict, close: list) -> dict[int, float]:
        """Per test cell: training rows farther than this from its pivot are
        no neighbours of any test row in it."""
        if self.p < 1:
            return {i: math.inf for i in radius}
        between = distances(pivots, pivots, self.p)
        cells = np.array([r["cell"] for r in close])
        gaps = np.array([r["r"] for r in close])
        reach = {}
        for i, (_, widest) in radius.items():
            bound = np.partition(widest + between[i, cells] + gaps, self.k - 1)[self.k - 1]
            reach[i] = float((bound + widest) * (1 + 1e-9) + 10.0**-RANK_DIGITS)
        return reach

    @staticmethod
    def _lookup(numbers: dict[int, int]) -> Column:
        pairs = [x for i, n in numbers.items() for x in (F.lit(i), F.lit(n))]
        return F.element_at(F.create_map(*pairs), F.col("cell"))

    def predict(self, frame: Frame) -> DataFrame:
        frame = as_trained(frame, self.train.features)
        if self.held is None or self.hashes is not None:
            return self._predict_routed(frame)
        held, k, p = self.held, self.k, self.p
        n_classes, by_distance = len(self.classes), self.by_distance

        def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) == 0:
                    continue
                d, best = held.value.nearest(_matrix(batch["x"]), k, p)
                shares = _shares(d, held.value.classes[best], n_classes, by_distance)
                yield batch.drop(columns="x").assign(__p=list(shares))

        tests = frame.df.select(*[col(c) for c in frame.keys], feature_array(frame).alias("x"))
        kept = tests.drop("x").schema
        voted = self._dealt(tests).mapInPandas(vote, T.StructType([
            *kept.fields, T.StructField("__p", T.ArrayType(T.DoubleType()))]))
        return predictions(voted, frame.keys, self.classes, F.col("__p"))

    def release(self) -> None:
        """Free the broadcast rows; nothing can be predicted afterwards."""
        if self.held is not None:
            self.held.destroy()

    def _predict_routed(self, frame: Frame) -> DataFrame:
        found = self.neighbors(frame)
        share = 1.0 / F.col("d") if self.by_distance else F.lit(1.0)
        same = F.col("d") == 0
        sums = []
        for i in range(len(self.classes)):
            mine = F.col("c") == i
            counted = mine & ~same if self.by_distance else mine
            sums.append(F.sum(F.when(counted, share).otherwise(0.0)).alias(f"w{i}"))
            sums.append(F.count_if(mine & same).cast("double").alias(f"z{i}"))
        votes = found.groupBy("t").agg(*sums)
        weights = F.array(*[F.col(f"w{i}") for i in range(len(self.classes))])
        exact = F.array(*[F.col(f"z{i}") for i in range(len(self.classes))])
        if self.by_distance:
            weights = F.when(F.array_max(exact) > 0, exact).otherwise(weights)
        votes = votes.select(col("t").alias(frame.row_id), weights.alias("__w"))
        total = F.aggregate("__w", F.lit(0.0), lambda a, b: a + b)
        keyed = frame.df.select(*[col(k) for k in frame.keys]).join(votes, frame.row_id)
        return predictions(keyed, frame.keys, self.classes,
                           F.transform("__w", lambda w: w / total))


def _training_rows(frame: Frame, classes: tuple) -> DataFrame:
    return frame.df.select(
        col(frame.row_id).alias("o"),
        class_index(col(frame.label), classes).cast("int").alias("c"),
        feature_array(frame).alias("x"))


class NeighborsClassifier:
    """Vote of the k nearest training rows; vote ties go to the smallest class,
    distance ties to the smallest row id.

    Neighbours are exact, unless ``recall`` below 1 allows to miss some: then rows
    are hashed (``lsh``), if that reaches the recall with less work, p in (0, 2].
    """

    def __init__(self, n_neighbors: int = 5, p: float = 2.0, weights: str = "uniform",
                 broadcast_bytes: int = BROADCAST_BYTES, recall: float = 1.0, random_state: int = 0):
        if weights not in ("uniform", "distance"):
            raise ValueError(f"weights must be uniform or distance, not {weights!r}")
        if n_neighbors < 1 or p <= 0:
            raise ValueError("n_neighbors and p must be positive")
        self.k, self.p, self.by_distance = n_neighbors, p, weights == "distance"
        if not 0 < recall <= 1:
            raise ValueError(f"recall must lie in (0, 1], not {recall!r}")
        if recall < 1 and p > 2:
            raise ValueError("hashing needs p of at most 2")
        self.broadcast_bytes, self.recall, self.seed = broadcast_bytes, recall, random_state

    def fit(self, frame: Frame) -> FittedNeighbors:
        counts = class_counts(frame.df, frame.label)
        rows = sum(n for _, n in counts)
        if rows < self.k:
            raise ValueError(f"{self.k} neighbours asked of {rows} training rows")
        classes, held = tuple(c for c, _ in counts), None
        if rows * (8 * frame.n_features + 24) <= self.broadcast_bytes:
            block = _Block.of(_training_rows(frame, classes).toArrow().to_pandas())
            held = frame.df.sparkSession.sparkContext.broadcast(block)
        hashes = None
        if self.recall < 1 and held is None:
            p = self.p
            hashes = lsh.choose(_training_rows(frame, classes), self.k, p, self.recall, rows,
                                self.seed, lambda a, b: distances(a, b, p))
        return FittedNeighbors(frame, classes, rows, self.k, self.p, self.by_distance, held, hashes)
