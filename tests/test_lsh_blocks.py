"""Rows that share a bucket, block by block and in bounded memory."""

import tracemalloc

import numpy as np
import pytest

from foldwise.models import lsh
from foldwise.models import neighbors as N


def hashes(rng, tables=6, m=3, d=8, width=2.0, probes=9):
    return lsh.Hashes(rng.normal(size=(tables, m, d)), rng.uniform(size=(tables, m)), width, probes)


def met_by_hand(h, tests, x):
    return (h.buckets(x)[:, None, :, None] == h.looked_up(tests)[None]).any(axis=(2, 3))


def test_looking_up_many_buckets_takes_little_memory():
    rng = np.random.default_rng(0)
    h, x = hashes(rng, 24, 10, 64, 2.0, 41), rng.normal(size=(4_000, 64))
    tracemalloc.start()
    looked = h.looked_up(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert looked.shape == (4_000, 24, 41)
    assert peak - looked.nbytes < 64 * 2**20


def test_the_likeliest_steps_are_looked_up():
    rng = np.random.default_rng(1)
    h, x = hashes(rng, probes=9), rng.normal(size=(300, 8))
    places = h._places(x)
    cells = np.floor(places)
    below = places - cells
    cost = np.concatenate([below, 1 - below], axis=2) ** 2 @ h._moves.T
    best = np.argsort(cost, axis=2, kind="stable")[:, :, :8]
    change = h._moves[:, 3:] - h._moves[:, :3]
    keys = h._mixed(h._sums(cells[:, :, None, :] + change[best]))
    assert (np.sort(keys, axis=2) == np.sort(h.looked_up(x)[:, :, 1:], axis=2)).all()
    # Equal costs: no more than asked for.
    assert all(len(set(places)) == 3 for places in lsh._least(np.ones((2, 5)), 3).tolist())


@pytest.mark.parametrize("tests", [1, 64, 130])
def test_rows_that_meet(tests):
    rng = np.random.default_rng(2)
    h, x, t = hashes(rng), rng.normal(size=(700, 8)), rng.normal(size=(tests, 8))
    met = lsh.Shelf(h, x).met(t)
    assert met.shape == (700, tests) and 0 < met.sum() < met.size
    assert (met == met_by_hand(h, t, x)).all()


@pytest.mark.parametrize("p", [1.0, 1.5, 2.0])
@pytest.mark.parametrize("pairs", [50, 10**6])
def test_nearest_of_the_rows_that_meet(p, pairs, monkeypatch):
    monkeypatch.setattr(N, "_PAIRS", pairs)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1_500, 8)), np.tile(rng.normal(size=8), (900, 1))])
    t = np.concatenate([rng.normal(size=(40, 8)), x[-3:], np.full((1, 8), 50.0)])
    h = hashes(rng)
    met = met_by_hand(h, t, x)
    met[:, 0] = False
    met[[5, 9], 0] = True
    block = N._Block(x, np.arange(len(x)), np.zeros(len(x), dtype=int))
    at, d, best = block._met(t, met, 5, p)
    for i in range(len(t)):
        own = np.flatnonzero(met[:, i])
        every = N.distances(t[i:i + 1], x[own], p)[0]
        order = np.argsort(np.round(every, N.RANK_DIGITS), kind="stable")[:5]
        assert (best[at == i] == own[order]).all()
        assert np.allclose(d[at == i], every[order], rtol=1e-12)
    # Two meet the first row, none the last.
    assert (at == 0).sum() == 2 and (at == len(t) - 1).sum() == 0


def test_blocks_hold_few_rows_whatever_the_look_ups(spark, monkeypatch):
    monkeypatch.setattr(lsh, "ROWS_A_PART", 100)
    rows = spark.range(1_000).selectExpr("id AS t", "id AS o", "0 AS c", "array(1.0D) AS x")

    def sizes(a, b):
        return a[:1].assign(d=float(len(b)), o=len(a), c=0)[["t", "d", "o", "c"]]

    found = lsh.candidates(rows.select("o", "c", "x"), rows.select("t", "x"), sizes, (60, 10**6),
                           1_000, "t bigint, d double, o bigint, c int").toPandas()
    assert found["o"].max() < 120 and found["d"].max() < 180
