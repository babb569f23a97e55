"""Fingerprints: edited texts, equal texts, likeness beside exact similarity."""

import hashlib
import re

import numpy as np
import pytest

from foldwise.llm import fingerprint


def sets(text):
    w = [x for x in re.split("[\x20\x09-\x0D]+", text) if x]
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def held(docs, tolerance):
    rows = docs.collect()
    # Rows equal in id and text are one document.
    distinct = sorted({(r["doc_id"], r["text"] or "") for r in rows},
                      key=lambda r: (-2**63 if r[0] is None else r[0],))
    got = fingerprint.fingerprinted(docs).collect()
    assert len(got) == len(rows)
    text_of = {i: t for i, t in distinct}
    following = {i: distinct[(k + 1) % len(distinct)][1] for k, (i, _) in enumerate(distinct)}
    by_text = {}
    for r in got:
        text, after = text_of[r["doc_id"]], following[r["doc_id"]]
        k = len(text) // 4
        edited = text[:len(text) - k] + after[:k]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == fingerprint.BINS
        by_text.setdefault(text, set()).add(r["fingerprint"])
        by_text.setdefault(edited, set()).add(r["edited_fingerprint"])
        assert r["near_edited"] == pytest.approx(jaccard(sets(text), sets(edited)), abs=tolerance)
        assert r["near_next"] == pytest.approx(jaccard(sets(text), sets(after)), abs=tolerance)
    assert all(len(v) == 1 for v in by_text.values())


def test_odd_rows(odd_docs):
    held(odd_docs.where("doc_id != 15 or doc_id is null"), 0.2)


def test_likeness(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(900)]
    rows = []
    for i in range(24):
        own = list(base)
        for k in rng.integers(0, 900, 6 * i):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own[:80 + 35 * i])))
    held(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 0.15)


def test_one_and_none(spark, no_docs):
    one = spark.createDataFrame([(3, "a b c d e f g h")], "doc_id bigint, text string")
    held(one, 0.2)
    assert fingerprint.fingerprinted(no_docs).collect() == []
