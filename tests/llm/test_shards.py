"""Shards: sizes, slots, the permutation and its inverse."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldwise.llm import shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", shards.permuted(F.col("id"), n).alias("p"))
    rows = rows.withColumn("back", shards.unpermuted(F.col("p"), n)).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)


def test_shuffles(spark):
    n = 4000
    got = [r["p"] for r in spark.range(n).select(
        "id", shards.permuted(F.col("id"), n).alias("p")).orderBy("id").collect()]
    near = sum(abs(a - b) < n / 4 for a, b in zip(got, got[1:])) / n
    assert 0.35 < near < 0.55  # 7 / 16 of independent pairs
    assert Counter(p // (n // 4) for p in got[:n // 4]).most_common()[-1][1] > 200


def test_odd_rows(odd_docs):
    rows = shards.sharded(odd_docs, 4).collect()
    assert len(rows) == odd_docs.count()
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(4)) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


def test_reproducible(odd_docs):
    def place(df):
        return sorted((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"])
                      for r in shards.sharded(df, 3).collect())
    assert place(odd_docs) == place(odd_docs.repartition(1))


def test_no_rows(no_docs):
    assert shards.sharded(no_docs).collect() == []
