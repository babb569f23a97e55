"""Near copies beside brute force over all pairs of sets."""

import numpy as np

from conftest_llm import shingle_set
from foldwise.llm import neardup


def brute(rows):
    """component of each id, by all pairs of sets."""
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingle_set(text))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = [(i, s) for i, own in sets.items() for s in own if s]
    for k, (i, a) in enumerate(nodes):
        for j, b in nodes[:k]:
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def held(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute(rows)
    got = neardup.grouped(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for i, text in rows:
        by_id.setdefault(i, set()).add(len(shingle_set(text)))
    for r in got:
        assert r["n_shingles"] in by_id[r["doc_id"]]
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])
    return got


def test_odd_rows(odd_docs):
    held(odd_docs)


def test_no_rows(no_docs):
    assert neardup.grouped(no_docs).collect() == []


def test_chains_and_hot_group(spark):
    """A chain of near copies, where only neighbours are linked, and a large group."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows, text = [], list(base)
    for i in range(30):
        for k in rng.integers(0, 120, 2):
            text[k] = f"n{i}x{k}"
        rows.append((i, " ".join(text)))
    group = [f"g{i}" for i in range(200)]
    for i in range(150):
        own = list(group)
        own[int(rng.integers(0, 200))] = f"edit{i}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, " ".join(group)) for i in range(100)]
    rows += [(3000 + i, " ".join(rng.choice(base, 60))) for i in range(60)]
    held(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))


def test_same_id_ties_texts(spark):
    """Rows that share an id are one node with the links of all its texts."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (3, a), (7, b), (9, "c d e f g h")]
    got = {r["doc_id"]: r["component_id"] for r in held(
        spark.createDataFrame(rows, "doc_id bigint, text string"))}
    assert got == {5: 3, 3: 3, 7: 3, 9: 9}


def test_estimates_near_truth():
    rng = np.random.default_rng(4)
    errors = []
    for share in (0.2, 0.5, 0.75, 0.9):
        pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
        both = int(1000 * share)
        a = np.unique(pool[:1000])
        b = np.unique(np.concatenate([pool[:both], pool[2000:3000 - both]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = neardup.registers(a)[None], neardup.registers(b)[None]
        got = neardup.likely(ra, rb, np.array([float(len(a))]), np.array([float(len(b))]))[0]
        errors.append(abs(got - true))
    assert max(errors) < 0.15


def test_registers_merge():
    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(2))
    union = neardup.registers(np.union1d(a, b))
    assert (union == np.maximum(neardup.registers(a), neardup.registers(b))).all()
