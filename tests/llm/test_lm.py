"""Base scores beside a plain count, model scores as probabilities."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest_llm import words
from foldwise.llm import lm
from foldwise.llm.packing import pack, pack_sorted, unpack, unpack_sorted


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10


def held(docs):
    rows = [(r["doc_id"], words(r["text"]) + [None]) for r in docs.collect()]
    count = Counter(w for i, ws in rows if fold(i) for w in ws)
    n, v = sum(count.values()), len(count)
    expected = sorted(
        ((-1 if i is None else i), fold(i) == 0, len(ws), sum(count[w] > 0 for w in ws), n,
         sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in rows)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["held_out"], r["n_tokens"],
                  r["n_known"], r["train_tokens"], r["base_score"]) for r in
                 lm.scored(docs).collect())
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [g[5] for g in got] == pytest.approx([e[5] for e in expected])


def test_odd_rows(odd_docs):
    held(odd_docs)


def test_no_rows(no_docs):
    assert lm.scored(no_docs).collect() == []


def test_only_held_out(spark):
    held_out = [i for i in range(200) if fold(i) == 0][:3]
    df = spark.createDataFrame([(i, "a b") for i in held_out], "doc_id bigint, text string")
    got = lm.scored(df).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)


def test_learns_pairs(spark):
    """Texts with fixed word pairs: the model beats the base on held-out rows."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        text = []
        for _ in range(30):
            k = int(rng.integers(0, 20))
            text += [f"l{k}", f"r{k}"]
        rows.append((i, " ".join(text)))
    out = lm.scored(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    rows = [r for r in out.collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.6 * sum(r["base_score"] for r in rows)


def test_packing():
    rng = np.random.default_rng(3)
    for values in ([], [0], [255, 256], rng.integers(0, 2**63, 100)):
        values = np.array(values, dtype=np.uint64)
        assert (unpack(pack(values)) == values).all()
        values = np.sort(values)
        assert (unpack_sorted(pack_sorted(values)) == values).all()
