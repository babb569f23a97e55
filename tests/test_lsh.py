"""Recall of hashed neighbours beside exact ones; every row has its k neighbours."""

import numpy as np
import pytest

from foldwise.frame import Frame
from foldwise.models import NeighborsClassifier, lsh
from foldwise.models import neighbors as N


@pytest.fixture(scope="module")
def groups(spark):
    """Twenty groups of 64 dimensions, and a row far from all others."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64)) * 3
    at = rng.integers(0, 20, 2400)
    x = centres[at] + rng.normal(size=(2400, 64))
    x[0] = 500.0
    rows = [(i, f"g{a % 3}", *map(float, v)) for i, (a, v) in enumerate(zip(at, x))]
    schema = "row_id bigint, label string, " + ", ".join(f"x{j} double" for j in range(64))
    frame = Frame.of(spark.createDataFrame(rows, schema).repartition(4).cache(), "row_id", "label")
    return frame.where(frame.df.row_id % 6 > 0), frame.where(frame.df.row_id % 6 == 0)


def neighbours(fitted, frame):
    out = {}
    for r in fitted.neighbors(frame).collect():
        out.setdefault(r["t"], set()).add(r["o"])
    return out


@pytest.mark.parametrize("p", [1.0, 1.5, 2.0])
def test_recall(groups, p):
    train, test = groups
    exact = neighbours(NeighborsClassifier(5, p).fit(train), test)
    fitted = NeighborsClassifier(5, p, broadcast_bytes=0, recall=0.9).fit(train)
    assert fitted.hashes is not None
    found = neighbours(fitted, test)
    assert found.keys() == exact.keys() and all(len(v) == 5 for v in found.values())
    recall = np.mean([len(found[t] & exact[t]) / 5 for t in exact])
    assert recall >= 0.9
    # The row that shares no bucket was searched exactly.
    assert found[0] == exact[0]


def test_pieces_of_hot_buckets_change_nothing(groups, monkeypatch):
    train, test = groups
    fitted = NeighborsClassifier(3, broadcast_bytes=0, recall=0.9).fit(train)
    whole = neighbours(fitted, test)
    monkeypatch.setattr(N, "TRAIN_BLOCK", 7)
    monkeypatch.setattr(lsh, "ROWS_A_PART", 500)
    assert neighbours(fitted, test) == whole


def test_votes(groups):
    train, test = groups
    preds = NeighborsClassifier(5, broadcast_bytes=0, recall=0.9).fit(train).predict(test).collect()
    assert len(preds) == test.df.count()
    assert np.mean([r["pred"] == r["label"] for r in preds]) > 0.95


def test_options():
    with pytest.raises(ValueError, match="recall"):
        NeighborsClassifier(3, recall=0.0)
    with pytest.raises(ValueError, match="p of at most 2"):
        NeighborsClassifier(3, p=3.0, recall=0.9)


def test_looked_up_buckets_hold_the_own_one_first():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    hashes = lsh.Hashes(rng.normal(size=(3, 4, 8)), rng.uniform(size=(3, 4)), 1.0, 6)
    looked = hashes.looked_up(x)
    assert looked.shape == (50, 3, 6) and (looked[:, :, 0] == hashes.buckets(x)).all()
    assert all(len(set(row)) == 6 for table in looked for row in table)
