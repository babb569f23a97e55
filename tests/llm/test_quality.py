"""Held-out accuracy, and rows that teach nothing."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from foldwise.llm import quality


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(240):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(int(rng.integers(20, 90)))]
        bad = i % 4 == 0
        if bad:
            words = ([w.upper() + "!!" for w in words] if i % 8 else [words[0]] * 40)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 0 if bad else 1, 0))
    labels += [(None, 1, 0), (5000, 0, 0), (3, None, 1)]
    return (spark.createDataFrame(rows, "doc_id bigint, text string"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_held_out(made):
    docs, labels = made
    model = quality.fitted(docs, labels)
    score = {r["doc_id"]: r["__score"] for r in quality.scored(docs, model).collect()}
    held_out = [i for i in score if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(score[i] >= 0.5) == (i % 4 != 0) for i in held_out]
    assert len(held_out) > 40 and np.mean(right) > 0.95


def test_learns_from_its_rows_only(made):
    """Labels of held-out rows change nothing."""
    docs, labels = made
    from pyspark.sql import functions as F
    other = labels.withColumn("quality", F.when(
        quality.remainder(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fitted(docs, labels) == quality.fitted(docs, other)


def test_odd_rows(odd_docs, made):
    model = quality.fitted(*made)
    out = quality.scored(odd_docs, model)
    assert out.columns == [*odd_docs.columns, "__score"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r["__score"] <= 1 for r in rows)


def test_no_rows(no_docs, made):
    docs, labels = made
    assert quality.scored(no_docs, quality.fitted(docs, labels)).collect() == []
    for model in (quality.fitted(no_docs, labels), quality.fitted(docs, labels.limit(0))):
        assert {r["__score"] for r in quality.scored(docs, model).collect()} == {0.5}


def test_learns_from_every_row(spark, monkeypatch):
    """The threshold is the quantile of all training strengths, however many rows there are."""
    from pyspark.sql import functions as F
    n = 24_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 4 == 0, F.concat(F.lit("BAD!! "), F.col("id").cast("string")))
        .otherwise(F.concat(F.lit("some good words, number "), F.col("id").cast("string"))).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 4 != 0).cast("int").alias("quality"))
    seen = []
    whole = quality._paired
    monkeypatch.setattr(quality, "_paired", lambda rows, bad, good, least: (
        seen.append((bad, good)), whole(rows, bad, good, least))[1])
    model = quality.fitted(docs, labels, held_out=None, pairs=1_000)
    assert seen == [(n // 4, n - n // 4)]
    wrong = quality.scored(docs, model).where((F.col("__score") >= 0.5) != (F.col("doc_id") % 4 != 0))
    assert wrong.count() == 0


@pytest.mark.parametrize("goods, bads", [(7, 3), (3, 7), (5, 5)])
def test_every_row_is_in_a_pair(spark, goods, bads):
    from pyspark.sql import functions as F
    width = len(quality.FEATURES)
    rows = [(f"g{i}", 1, [100.0 * (i + 1)] * width) for i in range(goods)]
    rows += [(f"b{i}", 0, [float(i)] * width) for i in range(bads)]
    df = spark.createDataFrame(rows, "k string, y int, x array<double>")
    for least, turns in ((1, 1), (14, 2), (10**6, min(goods, bads))):
        met = [r["d"][0] for r in quality._paired(df, bads, goods, least).select("d").collect()]
        turns = min(turns if least > 1 else 1, goods, bads) if least != 14 else -(-14 // max(goods, bads))
        assert len(met) == len(set(met)) == max(goods, bads) * turns
        assert {int(d + 50) // 100 for d in met} == set(range(1, goods + 1))


def test_texts_pass_once(made):
    """Only the text goes to Python, in one step, and it does not come back."""
    docs, labels = made
    plan = quality.scored(docs, quality.fitted(docs, labels))
    for out in (plan, plan.where("__score >= 0.5"), plan.where("__score >= 0.5").drop("__score")):
        told = out._jdf.queryExecution().executedPlan().toString()
        assert told.count("ArrowEvalPython [_listed(text#") == 1 and "MapInArrow" not in told


def test_slices_change_nothing(monkeypatch):
    """Texts are taken apart in small slices, whatever their sizes."""
    texts = pa.array([None, "", *[f"Some words{i}, of {i % 7}! " * (i % 90) for i in range(400)]])
    seen, features = [], quality._features
    monkeypatch.setattr(quality, "_features", lambda data, offsets: seen.append(len(data)) or features(data, offsets))
    rows = quality._listed(texts).to_pylist()
    assert len(seen) > 1 and max(seen) <= 1 << 18
    assert rows == [quality._listed(texts.slice(k, 1)).to_pylist()[0] for k in range(len(texts))]
