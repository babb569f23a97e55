"""Nearest neighbours in many dimensions by p-stable hashing, opt-in and approximate.

A table hashes a row to the places of its projections, cut into steps of a width
(Datar et al., 2004). A test row looks into the buckets of several tables, and in
each also into those that its projections nearly reach (multi-probe, Lv et al.,
2007). All rows found are compared exactly; k of them are left.

A row looks into up to a thousand buckets, so it is not sent to each of them: both
sides are cut into blocks, a task takes a block of either side, and sorts the
training rows by bucket. What it holds does not grow with the number of look-ups.

Width, functions and tables are chosen at fit: some training rows are probes,
whose exact neighbours are found in one pass; of all settings whose recall over
the probes reaches the target the one with the fewest candidates is taken. A
test row that finds fewer than k rows is searched exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.hashing import order_key

PROBES = 96
SAMPLE = 4_096
MAX_TABLES = 24
# Recall over the probes beyond the target, for what so few can tell.
MARGIN = 0.03
# Looking into a bucket costs as much as comparing so many rows.
LOOKUP = 20.0
# Training rows of a block at most, and test rows.
ROWS_A_PART = 100_000
# Blocks of test rows at least, if there are so many pairs that they pay.
LEAST_BLOCKS, BLOCK_PAIRS = 16, 100_000_000
# Bytes of what is held at once to hash rows.
_CHUNK = 8 * 2**20


def _stable(rng: np.random.Generator, p: float, shape: tuple) -> np.ndarray:
    """Numbers of the symmetric p-stable distribution, 0 < p <= 2 (Chambers et al., 1976)."""
    if p == 2:
        return rng.normal(size=shape)
    angle = rng.uniform(-math.pi / 2, math.pi / 2, shape)
    if p == 1:
        return np.tan(angle)
    wait = rng.exponential(size=shape)
    return (np.sin(p * angle) / np.cos(angle) ** (1 / p)
            * (np.cos((1 - p) * angle) / wait) ** ((1 - p) / p))


@dataclass(frozen=True)
class Hashes:
    """Tables of functions floor((a . x + b) / width), b in widths."""

    a: np.ndarray
    b: np.ndarray
    width: float
    probes: int

    @property
    def tables(self) -> int:
        return len(self.a)

    def first(self, tables: int) -> "Hashes":
        return replace(self, a=self.a[:tables], b=self.b[:tables])

    def _places(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,lmd->nlm", x, self.a) / self.width + self.b

    def _slices(self, rows: int, numbers: int) -> Iterator[slice]:
        """Cuts rows that need so many numbers for each table."""
        step = max(1, _CHUNK // (8 * self.tables * numbers))
        return (slice(i, i + step) for i in range(0, rows, step))

    @cached_property
    def _odd(self) -> np.ndarray:
        return np.random.default_rng(17).integers(1, 2**62, self.a.shape[1], dtype=np.uint64) * 2 + 1

    @cached_property
    def _moves(self) -> np.ndarray:
        """Steps down and up in one or two functions: a row of 0 and 1 for each."""
        m = self.a.shape[1]
        moves = [c for n in (1, 2) for c in combinations(range(2 * m), n)
                 if n == 1 or c[0] + m != c[1]]
        steps = np.zeros((len(moves), 2 * m))
        for i, c in enumerate(moves):
            steps[i, list(c)] = 1
        return steps

    def _sums(self, cells: np.ndarray) -> np.ndarray:
        """A weighted sum of each cell, a vector of whole numbers in the last axis."""
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64).astype(np.uint64) * self._odd).sum(axis=-1, dtype=np.uint64)

    @staticmethod
    def _mixed(sums: np.ndarray) -> np.ndarray:
        """One number for each sum."""
        with np.errstate(over="ignore"):
            mixed = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed ^ (mixed >> np.uint64(32))).astype(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        out = np.empty((len(x), self.tables), dtype=np.int64)
        for some in self._slices(len(x), self.a.shape[1]):
            out[some] = self._mixed(self._sums(np.floor(self._places(x[some]))))
        return out

    def looked_up(self, x: np.ndarray) -> np.ndarray:
        """For each row and table its bucket and the likeliest ones beside it."""
        m, moves = self.a.shape[1], self._moves
        most = min(self.probes - 1, len(moves))
        shift = self._sums(moves[:, m:] - moves[:, :m])
        out = np.empty((len(x), self.tables, 1 + most), dtype=np.int64)
        for some in self._slices(len(x), len(moves)):
            places = self._places(x[some])
            cells = np.floor(places)
            sums = self._sums(cells)
            out[some, :, 0] = self._mixed(sums)
            if most:
                # By how little the steps miss their bounds.
                below = places - cells
                cost = np.concatenate([below, 1 - below], axis=2) ** 2 @ moves.T
                best = _least(cost, most)
                out[some, :, 1:] = self._mixed(sums[:, :, None] + shift[best])
        return out


def _least(cost: np.ndarray, n: int) -> np.ndarray:
    """The places of the n least in the last axis."""
    low = cost <= np.partition(cost, n - 1, axis=-1)[..., n - 1:n]
    # Far faster than argpartition, but equal ones may be too many.
    if (low.sum(axis=-1) == n).all():
        return np.nonzero(low)[-1].reshape(*cost.shape[:-1], n)
    return np.argpartition(cost, n - 1, axis=-1)[..., :n]


class Shelf:
    """Some training rows by bucket."""

    def __init__(self, hashes: Hashes, x: np.ndarray):
        self.hashes, self.rows, self.tables = hashes, len(x), []
        for keys in hashes.buckets(x).T:
            buckets, own = np.unique(keys, return_inverse=True)
            self.tables.append((buckets, own.astype(np.int32)))

    def met(self, tests: np.ndarray) -> np.ndarray:
        """For each row here and test row whether they meet in a bucket."""
        words = -(-len(tests) // 64)
        out = np.zeros((self.rows, words), dtype=np.uint64)
        looked = self.hashes.looked_up(tests)
        for i, (buckets, own) in enumerate(self.tables):
            at = np.searchsorted(buckets, looked[:, i]).clip(max=len(buckets) - 1)
            hit = buckets[at] == looked[:, i]
            # A bit for each test row that looks into the bucket.
            held = np.zeros((len(buckets), 64 * words), dtype=bool)
            held[at[hit], np.nonzero(hit)[0]] = True
            out |= np.take(np.packbits(held, axis=1).view(np.uint64), own, axis=0)
        return np.unpackbits(out.view(np.uint8), axis=1)[:, :len(tests)].view(bool)


def choose(train: DataFrame, k: int, p: float, recall: float, rows: int, seed: int,
           nearest: Callable) -> Hashes | None:
    """Hashes that reach the recall over the probes, or None if none do with less work
    than a full scan. ``train`` has the columns o, x."""
    drawn = (train.select("o", "x", order_key(seed, F.col("o")).alias("h"))
             .orderBy("h").limit(SAMPLE).toPandas())
    sample = np.stack(drawn["x"].to_numpy()).astype(float)
    probes, ids = sample[:PROBES], drawn["o"].to_numpy()[:PROBES]
    owner, close, found = _exact(train, probes, ids, k, nearest)
    scale = float(np.median(found[found > 0])) if (found > 0).any() else 1.0
    rng = np.random.default_rng(seed)
    d = probes.shape[1]
    best: tuple[float, Hashes] | None = None
    for m in (1, 2, 3, 4, 6, 8, 10, 12):
        a = _stable(rng, p, (MAX_TABLES, m, d))
        b = rng.uniform(size=(MAX_TABLES, m))
        for stretch in (0.5, 1.0, 2.0, 4.0, 8.0):
            for n in (1, 2 * m + 1, 4 * m + 1):
                hashes = Hashes(a, b, scale * stretch, n)
                looked = hashes.looked_up(probes)
                hit = (looked[owner] == hashes.buckets(close)[:, :, None]).any(axis=2)
                reached = np.logical_or.accumulate(hit, axis=1).mean(axis=0)
                if reached[-1] < recall + MARGIN:
                    continue
                tables = int(np.argmax(reached >= recall + MARGIN)) + 1
                mine = hashes.first(tables)
                share = _share(mine, looked[:, :tables], sample)
                cost = share * rows + LOOKUP * tables * looked.shape[2]
                if cost < rows and (best is None or cost < best[0]):
                    best = cost, mine
    return best[1] if best else None


def _share(hashes: Hashes, looked: np.ndarray, sample: np.ndarray) -> float:
    """The share of all rows that a row is compared with, over the sample."""
    own = hashes.buckets(sample)
    return float(np.mean([np.isin(own[:, t], q[t]).mean() for q in looked[:32]
                          for t in range(hashes.tables)]) * hashes.tables)


def _exact(train: DataFrame, probes: np.ndarray, ids: np.ndarray, k: int, nearest: Callable
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe, vector, distance) of the k nearest other rows of each probe, in one pass."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, o = np.stack(batch["x"].to_numpy()).astype(float), batch["o"].to_numpy()
            every = nearest(probes, x)
            every[ids[:, None] == o[None, :]] = np.inf
            most = min(k, len(x))
            order = np.argsort(every, axis=1, kind="stable")[:, :most]
            flat = order.ravel()
            out = pd.DataFrame({"q": np.repeat(np.arange(len(probes)), most),
                                "d": np.take_along_axis(every, order, axis=1).ravel(),
                                "x": list(x[flat])})
            yield out[np.isfinite(out["d"])]

    parts = train.select("o", "x").mapInPandas(scan, "q int, d double, x array<double>")
    order = Window.partitionBy("q").orderBy("d")
    rows = (parts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
            .select("q", "d", "x").toPandas())
    return (rows["q"].to_numpy(), np.stack(rows["x"].to_numpy()).astype(float),
            rows["d"].to_numpy())


def candidates(train: DataFrame, tests: DataFrame, match: Callable, block_rows: tuple[int, int],
               rows: int, schema: str) -> DataFrame:
    """``match(tests, train)`` for every block of test rows and every block of training rows;
    a block holds as many rows as ``block_rows`` says, at most ``ROWS_A_PART``."""
    n = tests.count()
    most = [max(1, min(b, ROWS_A_PART)) for b in block_rows]
    n_test = max(math.ceil(n / most[0]), min(LEAST_BLOCKS, math.ceil(n * rows / BLOCK_PAIRS)), 1)
    n_train = max(math.ceil(rows / most[1]), 1)

    def own(column: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")

    def all_of(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = tests.select("t", "x", own("t", n_test).alias("tb"), all_of(n_train).alias("sb"))
    right = train.select("o", "c", "x", own("o", n_train).alias("sb"), all_of(n_test).alias("tb"))
    met = (left.groupBy("tb", "sb").cogroup(right.groupBy("tb", "sb"))
           .applyInPandas(match, schema))
    # Keys may repeat.
    return met.dropDuplicates(["t", "o"])
