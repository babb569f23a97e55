import math

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from foldwise.models import (BoostClassifier, EstimatorClassifier, ForestClassifier,
                             LogisticClassifier, NeighborsClassifier, SupportVectorClassifier)
from foldwise.models.svm import monomials
from foldwise.operators.folds import FoldPlan, assign_slices, side
from foldwise.operators.select import nan_to_null


@pytest.fixture(scope="module")
def halves(clouds):
    plan = FoldPlan(3)
    frame = assign_slices(clouds, plan)
    frame = frame.with_df(frame.df.cache())
    return side(frame, plan.in_group(0)), side(frame, plan.out_group(0))


def matrix(frame):
    rows = frame.df.orderBy("row_id").select("row_id", "label", *frame.features).collect()
    return ([r["row_id"] for r in rows], [r["label"] for r in rows],
            np.array([list(r)[2:] for r in rows]))


@pytest.mark.parametrize("model", [
    LogisticClassifier("l2", l2_c=1.0), LogisticClassifier("l1", l1_c=1.0),
    LogisticClassifier(None), NeighborsClassifier(5), ForestClassifier(10, "entropy"),
    BoostClassifier(6), SupportVectorClassifier("linear", max_iter=15),
    SupportVectorClassifier("poly", max_iter=15), SupportVectorClassifier("rbf", max_iter=15),
    lambda: EstimatorClassifier(NaiveBayes(modelType="gaussian")),
], ids=lambda m: f"{type(m).__name__}-{getattr(m, 'penalty', getattr(m, 'kernel', ''))}")
def test_models_separate_clouds_and_give_probabilities(halves, model):
    train, test = halves
    model = model() if callable(model) else model
    preds = model.fit(train).predict(test).collect()
    assert len(preds) == test.df.count()
    hits = sum(r["pred"] == r["label"] for r in preds) / len(preds)
    assert hits > 0.8
    for r in preds:
        assert list(r["proba"]) == ["c0", "c1", "c2"]
        assert sum(r["proba"].values()) == pytest.approx(1.0)
        if not isinstance(model, SupportVectorClassifier):
            assert r["proba"][r["pred"]] == max(r["proba"].values())


def test_logistic_solves_the_stated_objective(halves):
    """At the optimum the gradient of C * sum(loss) + |w|^2 / 2 vanishes."""
    train, _ = halves
    c = 0.5
    fitted = LogisticClassifier("l2", l2_c=c).fit(train)
    _, labels, x = matrix(train)
    w = fitted.model.coefficientMatrix.toArray()
    b = fitted.model.interceptVector.toArray()
    scores = x @ w.T + b
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    y = np.array([[l == k for k in fitted.classes] for l in labels], float)
    gradient = c * (p - y).T @ x + w
    assert np.abs(gradient).max() < 0.05 * len(labels) * c / 10


def test_logistic_strengths_and_what_they_need():
    assert LogisticClassifier("elasticnet", l1_c=1.0, l2_c=3.0).strength() == (4.0, 0.25)
    assert LogisticClassifier("l1", l1_c=2.0).strength() == (2.0, 1.0)
    assert LogisticClassifier(None).strength() == (None, 0.0)
    with pytest.raises(ValueError):
        LogisticClassifier("l2")
    with pytest.raises(ValueError):
        LogisticClassifier("l3")
    given = {"penalty": "l1", "solver": "saga", "l1_c": 1, "l2_c": 2}
    assert LogisticClassifier.sampled(given) == ["penalty", "solver", "l1_c"]


@pytest.mark.parametrize("p", [1.0, 1.5, 2.0, 0.5])
@pytest.mark.parametrize("budget", [2**26, 0])
def test_neighbors_equal_brute_force(halves, p, budget):
    train, test = halves
    k = 7
    found = NeighborsClassifier(k, p, broadcast_bytes=budget).fit(train).neighbors(test)
    got = {}
    for r in found.collect():
        got.setdefault(r["t"], []).append((round(r["d"], 9), r["o"]))
    ids, _, x = matrix(train)
    test_ids, _, z = matrix(test)
    for t, point in zip(test_ids, z):
        d = (np.abs(x - point) ** p).sum(axis=1) ** (1 / p)
        assert sorted(got[t]) == sorted(zip(np.round(d, 9), ids))[:k]


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_routed_votes_equal_broadcast_votes(halves, weights):
    train, test = halves
    near, far = (
        {r["row_id"]: (r["pred"], r["proba"]) for r in NeighborsClassifier(
            5, 2.0, weights, broadcast_bytes=b).fit(train).predict(test).collect()}
        for b in (2**26, 0))
    assert near.keys() == far.keys()
    for key, (pred, proba) in near.items():
        assert far[key][0] == pred and far[key][1] == pytest.approx(proba)


def test_routing_cuts_hot_cells_into_blocks(halves, monkeypatch):
    """Identical rows all fall into one cell; blocks still bound each task."""
    import foldwise.models.neighbors as N
    train, test = halves
    monkeypatch.setattr(N, "TEST_BLOCK", 10)
    monkeypatch.setattr(N, "TRAIN_BLOCK", 25)
    hot = train.with_df(train.df.withColumns({n: F.lit(1.0) for n in train.features}))
    found = NeighborsClassifier(4, broadcast_bytes=0).fit(hot).neighbors(test).collect()
    lowest = sorted(r[0] for r in hot.df.select("row_id").collect())[:4]
    by_test = {}
    for r in found:
        by_test.setdefault(r["t"], []).append(r["o"])
    assert len(by_test) == test.df.count()
    assert all(sorted(o) == lowest for o in by_test.values())


def test_identical_rows_outvote_when_weighted(spark):
    from foldwise.frame import Frame
    train = Frame.of(spark.createDataFrame(
        [(1, "a", 0.0), (2, "b", 1.0), (3, "b", 1.0)], "row_id int, label string, x double"),
        "row_id", "label")
    test = Frame.of(spark.createDataFrame(
        [(1, "a", 0.0), (2, "b", 0.5)], "row_id int, label string, x double"), "row_id", "label")
    rows = {r["row_id"]: r for r in
            NeighborsClassifier(3, weights="distance").fit(train).predict(test).collect()}
    assert rows[1]["proba"] == {"a": 1.0, "b": 0.0}
    assert rows[2]["proba"] == pytest.approx({"a": 1 / 3, "b": 2 / 3})
    uniform = NeighborsClassifier(2).fit(train).predict(test).collect()
    assert {r["row_id"]: r["pred"] for r in uniform} == {1: "a", 2: "a"}  # ties: smallest class
    with pytest.raises(ValueError, match="neighbours"):
        NeighborsClassifier(4).fit(train)


def test_importance_of_a_fitted_model(halves):
    from foldwise.operators.metrics import permutation_importance
    train, test = halves
    found = permutation_importance(NeighborsClassifier(5).fit(train), test, repeats=2).collect()
    scores = {r["feature"]: abs(r["importance"]) for r in found}
    assert list(scores) == sorted(scores, key=scores.get, reverse=True)
    assert min(scores, key=scores.get) == "d"  # the only feature that is noise


def test_nulls_and_text_do_not_reach_a_model(halves, flowers):
    train, _ = halves
    holes = train.with_df(train.df.withColumn("a", F.when(F.col("a") > 0, F.col("a"))))
    with pytest.raises(Exception, match="null"):
        NeighborsClassifier(3).fit(train).predict(holes).collect()
    with pytest.raises(Exception, match="null|NaN"):
        LogisticClassifier("l2", l2_c=1.0).fit(holes)
    from foldwise.operators.select import isolate_target
    with pytest.raises(TypeError, match="numeric"):
        NeighborsClassifier(3).fit(isolate_target(flowers, "target")).predict(
            isolate_target(nan_to_null(flowers), "target"))


def test_monomials_follow_the_expansion(spark):
    x = np.array([2.0, 3.0, 5.0])
    df = spark.createDataFrame([(Vectors.dense(x),)], ["v"])
    grown = PolynomialExpansion(degree=3, inputCol="v", outputCol="o").transform(df)
    expected = [math.prod(x[i] for i in m) for m in monomials(3, 3)[1:]]
    assert grown.first()["o"].toArray() == pytest.approx(expected)


def test_boosting_stops_at_a_perfect_stump(spark):
    from foldwise.frame import Frame
    frame = Frame.of(spark.range(40).selectExpr(
        "id AS row_id", "CASE WHEN id < 20 THEN 'n' ELSE 'y' END AS label",
        "CAST(id AS DOUBLE) AS x").coalesce(1), "row_id", "label")
    fitted = BoostClassifier(5).fit(frame)
    assert len(fitted.stumps) == 1
    assert all(r["pred"] == r["label"] for r in fitted.predict(frame).collect())


@pytest.mark.parametrize("kernel", ["poly", "rbf"])
def test_outputs_of_a_kernel_map_are_not_kept(spark, halves, kernel, monkeypatch):
    """What a fit persists is as wide as the features, not as the map."""
    kind, kept = type(halves[0].df), []
    persist = kind.persist

    def noted(df, *level):
        numbers = [len(c) / 8 if isinstance(c, bytes | bytearray) else len(c)
                   for row in df.collect() for c in row if hasattr(c, "__len__")]
        kept.append(sum(numbers))
        return persist(df, *level)

    monkeypatch.setattr(kind, "persist", noted)
    train, test = halves
    rows = train.df.count()
    fitted = SupportVectorClassifier(kernel, components=4_000, degree=12, max_iter=3).fit(train)
    assert fitted.feature_map.outputs > 400
    assert kept and max(kept) <= 2 * rows * train.n_features


def test_polynomial_map_is_the_kernel():
    from foldwise.models.svm import FeatureMap
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 5, 3))
    of = FeatureMap("poly", 3, 0.7, 3, 0.5).of
    # Without the constant monomial, which is an intercept.
    assert np.allclose((of(x) * of(y)).sum(axis=1), (0.7 * (x * y).sum(axis=1) + 0.5) ** 3 - 0.5**3)


def test_hinge_machines_reach_the_minimum(halves):
    """Another fit with many more steps gains next to nothing."""
    train, test = halves
    quick, long = (SupportVectorClassifier("rbf", C=10.0, components=32, max_iter=n).fit(train)
                   for n in (40, 400))
    a, b = ({r["row_id"]: r["pred"] for r in m.predict(test).collect()} for m in (quick, long))
    assert np.mean([a[k] == b[k] for k in a]) > 0.95


@pytest.mark.parametrize("kind", ["plain", "shifted", "ties", "copies", "far", "one"])
def test_bounded_distances_give_the_same_neighbors(kind):
    import foldwise.models.neighbors as N
    rng = np.random.default_rng(4)
    x, t = rng.normal(size=(3000, 6)), rng.normal(size=(60, 6))
    if kind == "shifted":
        x, t = x + 1e7, t + 1e7
    elif kind == "ties":
        x, t = np.round(x), np.round(t)
    elif kind == "copies":
        x = np.repeat(x[:300], 10, axis=0)
    elif kind == "far":
        t = t * 1e6
    elif kind == "one":
        x = np.ones_like(x)
    block = N._Block(x, np.arange(len(x)), np.zeros(len(x), int))
    if kind == "plain":
        assert len(block.screen.pairs(t, 5)[0]) < 0.01 * len(x) * len(t)
    for a, b in zip(block.nearest(t, 5, 2.0), block._all(t, 5, 2.0)):
        assert np.array_equal(a, b)


def test_broadcast_search_is_dealt_by_its_comparisons(halves, monkeypatch):
    import foldwise.models.neighbors as N
    train, test = halves
    fitted = NeighborsClassifier(5).fit(train)
    monkeypatch.setattr(N, "TASK_PAIRS", train.df.count() * 10, raising=False)
    rows = test.df.count()
    assert fitted.predict(test).rdd.getNumPartitions() == math.ceil(rows / 10)
    assert fitted.predict(test).count() == rows
