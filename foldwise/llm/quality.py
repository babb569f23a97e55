"""Quality scores by Bradley-Terry ranking of preference pairs.

A document's strength is a weighted sum of features of its text. Of a pair
(label 1, label 0) the first is preferred; the weights minimise the logistic
loss on the difference of features, with a small ridge. A document passes if
its strength reaches the quantile of training strengths that splits them as
the labels do; the score is the logistic function of the distance to it.

All labelled rows that are not held out are trained on. Each row of the larger
class meets rows of the other in turn: one, or as many as make ``PAIRS`` pairs in
all. Pairs are written once; a Newton step is a pass over them that sums gradient
and Hessian. Deviations and the quantile are those of all training rows, exactly.
Every document is scored, from its whole text, in one pass without a shuffle.

A null text counts as empty; an empty text has zero features and a score like
any other. Without labels of both kinds all weights are zero and every score
is 0.5. Labels that are null, or for ids that no document has, teach nothing;
several labels of an id, or several rows, teach several times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.ordered import class_positions, running_totals
from foldwise.llm.common import broadcast_if_small, is_small, stored
from foldwise.llm.tokens import text_slices, words

# Pairs that are made at least, if there are so many.
PAIRS = 100_000
# Training rows that one task numbers.
BUCKET_ROWS = 5_000
# Bytes of text whose words are held at once, in arrays many times as large.
SLICE_BYTES = 1 << 18
# Digits of a weight; those beyond depend on the order of sums.
DIGITS = 10
RIDGE = 1e-3
FEATURES = ("log_words", "word_bytes", "upper", "digits", "marks", "bars", "signs", "bangs",
            "stops", "lines", "distinct", "repeats", "distinct_pairs", "top_word")


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.float64)
    table[[ord(c) for c in chars]] = 1
    return table


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _class("abcdefghijklmnopqrstuvwxyz")
# Bytes of a class, per word; letters are taken apart.
_PER_WORD = [_class("0123456789"), _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), _class("|"),
             _class("#$%&*@~^"), _class("!"), _class("."), _class("\n")]


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)))
    hashes, bounds = words(data, offsets)
    n = np.diff(bounds)
    some = np.maximum(n, 1)
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    starts = offsets[:-1][full]

    def counted(table: np.ndarray) -> np.ndarray:
        found = np.zeros(rows)
        if len(full):
            found[full] = np.add.reduceat(table[data], starts)
        return found

    upper, lower = counted(_UPPER), counted(_LOWER)
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.minimum(size / some, 50)
    out[:, 2] = upper / np.maximum(upper + lower, 1)
    for k, table in enumerate(_PER_WORD):
        out[:, 3 + k] = np.minimum(counted(table) / some, 10)
    for i in np.flatnonzero(n):
        own = hashes[bounds[i]:bounds[i + 1]]
        _, counts = np.unique(own, return_counts=True)
        out[i, 10] = len(counts) / len(own)
        out[i, 13] = counts.max() / len(own)
        if len(own) > 1:
            out[i, 11] = np.mean(own[1:] == own[:-1])
            pairs = own[1:] * np.uint64(3) + own[:-1]
            out[i, 12] = len(np.unique(pairs)) / len(pairs)
    return out


def _listed(text: pa.Array) -> pa.Array:
    """The features of each text, a list; null is empty."""
    parts = [_features(data, offsets) for _, data, offsets in text_slices(text, SLICE_BYTES)]
    flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
    ends = np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def with_features(docs: DataFrame) -> DataFrame:
    """All columns of the documents and ``__features``.

    Only the text goes to Python, once, and only the features come back.
    """
    made = F.arrow_udf(_listed, T.ArrayType(T.DoubleType()))
    # Else a filter on what is made of the features would make them anew.
    return docs.withColumn("__features", made.asNondeterministic()(F.col("text")))


@dataclass(frozen=True)
class Ranking:
    """Weights of the raw features and the strength that a document must reach."""

    weights: tuple[float, ...]
    threshold: float

    def score(self, features: Column) -> Column:
        terms = F.lit(-self.threshold)
        for k, w in enumerate(self.weights):
            terms = terms + features[k] * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms))


def _training(docs: DataFrame, labels: DataFrame, label: str, held_out: int | None) -> DataFrame:
    """(k, y, x): a key, the label and the features of every training row."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    if held_out is not None:
        known = known.where(remainder(F.col("id")) != held_out)
        rows = rows.where(remainder(F.col("doc_id")) != held_out)
    same, n = F.col("doc_id") == F.col("id"), known.count()
    if is_small(n):
        taught = with_features(rows.join(F.broadcast(known), same).select("doc_id", "y", "text"))
    else:
        # Features are shuffled, texts are not.
        taught = with_features(rows).drop("text").join(known, same)
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("y"), F.xxhash64("__features"))
    return stored(taught.select(key.alias("k"), "y", F.col("__features").alias("x")), "quality")


def _paired(rows: DataFrame, bad: int, good: int, least: int) -> DataFrame:
    """(d): good features less bad ones, of each row of the larger class with rows of the other."""
    larger, smaller = max(good, bad), min(good, bad)
    turns = min(smaller, max(1, -(-least // larger)))
    placed = stored(class_positions(rows, "y", "k", 5, bucket_rows=BUCKET_ROWS), "quality-places")
    top = 1 if good >= bad else 0
    # Places count on from the bad rows to the good ones.
    at = F.col("position") - F.when(F.col("y") == 1, F.lit(bad)).otherwise(F.lit(0))
    many = placed.where(F.col("y") == top).select(F.col("x").alias("a"), at.alias("i"))
    turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn")
    many = many.select("a", "i", turn).select("a", F.pmod(F.col("i") + F.col("turn"), F.lit(smaller)).alias("j"))
    few = placed.where(F.col("y") != top).select(F.col("x").alias("b"), at.alias("j"))
    met = many.join(broadcast_if_small(few, smaller, 8 * len(FEATURES) * smaller), "j")
    sign = F.lit(1.0 if top == 1 else -1.0)
    return stored(met.select(F.zip_with("a", "b", lambda a, b: sign * (a - b)).alias("d")), "quality-pairs")


def _slopes(pairs: DataFrame, w: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient and Hessian of the pairwise loss, and how many pairs, in one job."""
    size = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 + size + size * size)
        for batch in batches:
            d = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) / scale
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
            sums += np.concatenate([[len(d)], -(d.T @ p), ((d.T * (p * (1 - p))) @ d).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums])], names=["part", "sums"])

    # One row a task, added in their order.
    parts = sorted(pairs.mapInArrow(run, "part int, sums array<double>").collect())
    sums = np.sum([r["sums"] for r in parts], axis=0)
    return sums[1:1 + size], sums[1 + size:].reshape(size, size), int(sums[0])


def _between(rows: DataFrame, strength: Column, k: int) -> float:
    """The middle between the k-th and the next of all strengths, in ascending order."""
    tally = rows.select(strength.alias("v")).groupBy("v").count()
    ranked = running_totals(tally, [], "v", {"count": "before"})
    end = F.col("before") + F.col("count")
    ranks = [(F.col("before") <= r) & (end > r) for r in (k - 1, k)]
    found = ranked.where(ranks[0] | ranks[1]).select("v").collect()
    return (min(r["v"] for r in found) + max(r["v"] for r in found)) / 2


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: int | None = 1,
           pairs: int = PAIRS, ridge: float = RIDGE) -> Ranking:
    """Learn from all labelled rows whose crc32 of the id mod 3 is not ``held_out``, by Newton's
    method on the pairwise logistic loss."""
    size = len(FEATURES)
    rows = _training(docs, labels, label, held_out)
    told = rows.agg(F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good"),
                    *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(size)]).first()
    bad, good = told["bad"], told["good"]
    if not bad or not good:
        return Ranking((0.0,) * size, 0.0)
    scale = np.array([told[f"s{i}"] or 1.0 for i in range(size)])
    met = _paired(rows, bad, good, pairs)
    w = np.zeros(size)
    for _ in range(30):
        gradient, hessian, count = _slopes(met, w, scale)
        step = np.linalg.solve(hessian / count + ridge * np.eye(size), gradient / count + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = tuple(float(f"{v:.{DIGITS}g}") for v in w / scale)
    strength = sum((F.col("x")[i] * F.lit(v) for i, v in enumerate(weights)), F.lit(0.0))
    return Ranking(weights, _between(rows, strength, bad))


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def scored(docs: DataFrame, model: Ranking) -> DataFrame:
    """All columns of the documents and ``__score`` (0 to 1)."""
    out = with_features(docs)
    return out.withColumn("__score", model.score(F.col("__features"))).drop("__features")
