"""Runs beside a scan of all lags of each text."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwise.llm import periodic, queries

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(words):
    """All lags; a stretch counts if no shorter lag holds in it."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            own = words[s:s + length]
            if length >= max(6, 4 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out)


def check(texts):
    n, runs, kept = periodic.found([" ".join(t).encode() for t in texts])
    for words, count, own, left in zip(texts, n, runs, kept):
        expected = brute(words)
        assert count == len(words) and own == expected
        gone = {k for s, length, q in expected for k in range(s + q, s + length)}
        assert left.decode() == " ".join(w for k, w in enumerate(words) if k not in gone)


def repeated(root, length):
    return [root[k % len(root)] for k in range(length)]


def test_random_runs():
    """Runs of all periods up to 70, side by side, in words of few and many kinds."""
    rng = np.random.default_rng(2)
    texts = []
    for k in range(400):
        text = []
        for _ in range(int(rng.integers(1, 4))):
            kinds = int(rng.choice([2, 3, 40]))
            text += [f"w{x}" for x in rng.integers(0, kinds, int(rng.integers(0, 30)))]
            q = int(rng.integers(1, 71))
            root = [f"w{x}" for x in rng.integers(0, kinds, q)]
            text += repeated(root, int(rng.integers(3 * q, 6 * q + 2)))
        texts.append(text)
    check(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=40),
                                   st.integers(1, 7)), max_size=5), max_size=4))
def test_any_texts(texts):
    check([[w for root, times in text for w in root * times] for text in texts])


def test_long_periods_and_limits():
    """Each period at and below its least length, roots of words that repeat themselves."""
    texts = []
    for q in (1, 2, 6, 7, 8, 9, 15, 16, 17, 31, 32, 63, 64, 100, 128, 200):
        root = [f"r{k}" for k in range(q)]
        rare = ["a"] * (q - 1) + ["b"]
        for words in (root, rare):
            texts += [["x", *repeated(words, max(6, 4 * q) + d), "y"] for d in (-1, 0, 1)]
            texts.append(repeated(words * 2, 9 * q))
    check(texts)
    # Periods of whole texts next to each other don't run over their bounds.
    check([["a"] * 5, ["a"] * 5, ["a"] * 6, [], ["a"] * 3])


def test_equal_hashes(monkeypatch):
    """Hashes that all agree only cost time."""
    monkeypatch.setattr(periodic, "mix", lambda x: x & np.uint64(3))
    root = [f"r{k}" for k in range(20)]
    texts = [["x", *repeated(root, 90), *[f"t{k}" for k in range(30)]], [f"u{k}" for k in range(80)]]
    for words, own in zip(texts, periodic.found([" ".join(t).encode() for t in texts])[1]):
        assert set(own) <= set(brute(words))


def test_strongest():
    runs = [(0, 12, 3), (5, 8, 2), (5, 8, 1), (40, 16, 2), (3, 24, 3)]
    assert periodic.strongest(runs) == (3, 24, 3)
    assert periodic.strongest([]) is None


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = [None, "", " \n", "a", "b b b b b b", "É É  É\tÉ É\x0bÉ É\x85É"]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(1, 400)))) for _ in range(150)]
    rows = [(i, t, i, "s") for i, t in enumerate(texts)] + [(7, texts[7], 7, "s"), (None, "c " * 9, 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words bigint, runs string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    expected = []
    for i, t, *_ in rows:
        words = planted(i, t)
        runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        expected.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                         hashlib.sha256(listed.encode()).hexdigest(),
                         hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert any(r["n_runs"] for r in got) and len(got) == len(rows)


def test_rows(odd_docs, no_docs):
    out = periodic.with_runs(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_words", "runs", "strongest", "collapsed"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        words = WORD.findall(r["text"] or "")
        assert r["n_words"] == len(words)
        if len(words) < 2000:
            assert [tuple(x) for x in r["runs"]] == brute(words)
    assert periodic.with_runs(no_docs).collect() == []
