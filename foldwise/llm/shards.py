"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Row ``i`` of N goes to place ``p(i)``, where p is a keyed permutation of
[0, N). Shard and slot are ``p % shards`` and ``p // shards``, so shard sizes
differ by one at most (law ``rows``), slots have no gaps, and anyone who knows
N, the seed and a row number can compute where the row lies, and back.

The permutation works on a grid of a * b cells, where a = ceil(sqrt(N)) and
b = ceil(N / a). Fewer than a cells lie outside [0, N); a row that lands there
is permuted again until it is inside.

Rows are numbered by (bucket, doc_id, text checksum, size), where the bucket
is a hash of these. Buckets are numbered beside each other and prefix sums of
their counts are added, so no task sees more than a few buckets. The numbering
depends on the rows alone, not on their partitions. Rows equal in id, checksum
and size are interchangeable. A null text has no bytes and checksum 0; a null
id is an id like any other. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import broadcast_if_small, stored

ROUNDS = 6  # even: the halves are back in their places
SEED = 20_011
# Walks that the expression allows. Fewer than a cells lie outside, so it can't
# run out while a < WALKS; beyond, each walk ends with a chance above 1 - 1 / a.
WALKS = 64
ROWS_A_BUCKET = 50_000
LEAST_BUCKETS = 1_024
_PRIME = 2_147_483_647


def _grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below the prime for each round."""
    keys, x = [], seed % _PRIME or 1
    for _ in range(ROUNDS):
        three = []
        for _ in range(3):
            x = (x * 48_271 + 11) % _PRIME
            three.append(x or 1)
        keys.append(tuple(three))
    return keys


def _round(half: Column, key: tuple[int, int, int]) -> Column:
    """A quadratic function of half modulo the prime; products stay below 2^62."""
    linear = (half % F.lit(_PRIME) * F.lit(key[0]).cast("bigint") + F.lit(key[1])) % F.lit(_PRIME)
    return (linear * linear + F.lit(key[2])) % F.lit(_PRIME)


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("bigint"))


def _once(x: Column, n: int, seed: int) -> Column:
    a, b = _grid(n)
    left, right = x % F.lit(a), _div(x, a)
    for k, key in enumerate(_keys(seed)):
        left, right = right, (left + _round(right, key)) % F.lit(b if k % 2 else a)
    return right * F.lit(a).cast("bigint") + left


def _back(x: Column, n: int, seed: int) -> Column:
    a, b = _grid(n)
    left, right = x % F.lit(a), _div(x, a)
    for k, key in reversed(list(enumerate(_keys(seed)))):
        left, right = F.pmod(right - _round(left, key), F.lit(b if k % 2 else a)), left
    return right * F.lit(a).cast("bigint") + left


def _walked(x: Column, n: int, step) -> Column:
    inside = F.lit(n).cast("bigint")
    end = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), step(x),
                      lambda at, _: F.when(at < inside, at).otherwise(step(at)))
    return F.when(end < inside, end).otherwise(
        F.raise_error(F.lit("cycle walking has not ended")).cast("bigint"))


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """The place of row ``number`` of n."""
    return _walked(number.cast("bigint"), n, lambda x: _once(x, n, seed))


def unpermuted(place: Column, n: int, seed: int = SEED) -> Column:
    """The row number that lies at a place."""
    return _walked(place.cast("bigint"), n, lambda x: _back(x, n, seed))


def shard_of(place: Column, shards: int) -> Column:
    return (place % F.lit(shards)).cast("int")


def slot_of(place: Column, shards: int) -> Column:
    return _div(place, shards)


def numbered(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows with ``number``, 0 to n - 1 in (hash bucket, order); the rows are stored."""
    buckets = max(LEAST_BUCKETS, n // ROWS_A_BUCKET)
    keyed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = keyed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    # One row for each bucket: the only sum over an unpartitioned window.
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0))
                           .alias("__start"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return (keyed.withColumn("__place", place)
            .join(broadcast_if_small(starts, buckets), "__bucket")
            .withColumn("number", F.col("__start") + F.col("__place") - 1)
            .drop("__bucket", "__place", "__start"))


def sharded(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, number, place, shard and slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32")), "shard-rows")
    n = rows.count()
    out = numbered(rows, ["doc_id", "text_crc32", "size"], n)
    return (out.withColumn("place", permuted(F.col("number"), n, seed))
            .withColumn("shard", shard_of(F.col("place"), shards))
            .withColumn("slot", slot_of(F.col("place"), shards)))
