"""Many cells fitted together are as good as each fitted by itself."""

import math

import numpy as np
import pytest

from foldwise.models import BoostClassifier, LogisticClassifier, boost, newton
from foldwise.models.cells import TrainSide, gather
from foldwise.operators.folds import FoldPlan, assign_slices, side

PLAN = FoldPlan(2, 3)


@pytest.fixture(scope="module")
def sliced(clouds):
    frame = assign_slices(clouds, PLAN)
    return frame.with_df(frame.df.cache())


def cells_of(frame, plan=PLAN):
    own = {(r, x): TrainSide(frame, tuple(plan.cross_train(r, x)))
           for r in range(plan.replicates) for x in range(plan.crosses)}
    return own | {(r, None): TrainSide(side(frame, plan.in_group(r))) for r in range(plan.replicates)}


def matrix(frame):
    rows = frame.df.select("label", *frame.features).collect()
    return np.array([list(r)[1:] for r in rows]), np.array([r["label"] for r in rows])


@pytest.mark.parametrize("penalty", ["l1", "l2", "elasticnet", None])
def test_logistic_minimum_of_every_cell(sliced, penalty):
    model = LogisticClassifier(penalty, l1_c=0.4, l2_c=0.8)
    sides = cells_of(sliced)
    fitted = LogisticClassifier.fit_cells({k: (model, s) for k, s in sides.items()})
    c, share = model.strength()
    for key, s in sides.items():
        x, labels = matrix(s.rows())
        y = np.searchsorted(np.array(fitted[key].classes), labels)
        w = fitted[key].weights
        assert fitted[key].classes == ("c0", "c1", "c2")
        g = newton.sums_of(x, y, w)[1:1 + w.size].reshape(w.shape)
        assert np.abs(g[:, -1]).max() < 1e-4
        g, w = g[:, :-1], w[:, :-1]
        strength = 0.0 if c is None else 1.0 / c
        g = g + strength * (1 - share) * w
        if penalty == "l1":
            assert (w == 0).any()
        slope = np.where(w == 0, np.maximum(np.abs(g) - strength * share, 0),
                         np.abs(g + strength * share * np.sign(w)))
        assert slope.max() < 1e-4


def test_together_as_alone(sliced):
    model = LogisticClassifier("l2", l2_c=0.5)
    train, test = side(sliced, PLAN.in_group(0)), side(sliced, PLAN.out_group(0))
    together = LogisticClassifier.fit_cells({"a": (model, TrainSide(train))})["a"].predict(test)
    alone = model.fit(train).predict(test)
    one, two = ({r["row_id"]: r for r in p.collect()} for p in (together, alone))
    assert one.keys() == two.keys()
    for k, r in one.items():
        assert r["pred"] == two[k]["pred"]
        assert r["proba"] == pytest.approx(two[k]["proba"], abs=2e-3)


def test_two_classes_and_lacking_ones(spark, sliced):
    """Cells whose training rows lack a class know only the others."""
    two = sliced.where(sliced.df.label != "c1")
    model = LogisticClassifier("l2", l2_c=1.0)
    fitted = LogisticClassifier.fit_cells({"all": (model, TrainSide(sliced)), "two": (model, TrainSide(two))})
    assert fitted["two"].weights.shape == (1, 5) and fitted["two"].classes == ("c0", "c2")
    preds = fitted["two"].predict(two).collect()
    assert sum(r["pred"] == r["label"] for r in preds) > 0.9 * len(preds)
    boosted = BoostClassifier.fit_cells({"two": (BoostClassifier(4), TrainSide(two))})
    assert boosted["two"].classes == ("c0", "c2")
    with pytest.raises(ValueError, match="two classes"):
        gather({0: TrainSide(sliced.where(sliced.df.label == "c1"))})


def test_separable_classes_come_to_an_end(spark):
    from foldwise.frame import Frame
    frame = Frame.of(spark.range(40).selectExpr("id AS row_id", "id >= 20 AS label",
                                                "CAST(id AS DOUBLE) AS x"), "row_id", "label")
    fitted = LogisticClassifier.fit_cells({0: (LogisticClassifier(None), TrainSide(frame))})[0]
    assert all(r["pred"] == r["label"] for r in fitted.predict(frame).collect())


def test_wide_cells_fit_one_by_one_or_in_waves(sliced, monkeypatch):
    model = LogisticClassifier("l2", l2_c=0.5)
    sides = {k: (model, s) for k, s in cells_of(sliced).items()}
    usual = LogisticClassifier.fit_cells(sides)
    # Room for two cells at a time.
    monkeypatch.setattr("foldwise.models.cells.DRIVER_NUMBERS", 2 * newton.numbers(
        gather({0: TrainSide(sliced)}).cells[0]))
    waved = LogisticClassifier.fit_cells(sides)
    for k in sides:
        assert waved[k].weights == pytest.approx(usual[k].weights)
    monkeypatch.setattr("foldwise.models.linear.DRIVER_NUMBERS", 1)
    one = LogisticClassifier.fit_cells({0: (model, TrainSide(sliced))})[0]
    assert hasattr(one, "model")


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


@pytest.mark.parametrize("model", [LogisticClassifier("elasticnet", l1_c=1.0, l2_c=1.0), BoostClassifier(3)],
                         ids=["logistic", "boost"])
def test_jobs_do_not_grow_with_cells(spark, clouds, model):
    used = []
    for plan in (FoldPlan(2, 2), FoldPlan(4, 4)):
        frame = assign_slices(clouds, plan)
        frame = frame.with_df(frame.df.cache())
        sides = {k: (model, s) for k, s in cells_of(frame, plan).items() if k[1] is not None}
        frame.df.count()
        before = jobs(spark)
        type(model).fit_cells(sides)
        used.append(jobs(spark) - before)
    assert used[1] <= used[0] + 6  # at most a step or two more to the last cell's minimum


def plain_boost(x, y, k, rounds, rate):
    """SAMME with exact splits."""
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= t
                sides = [np.bincount(y[m], w[m], minlength=k) for m in (low, ~low)]
                impurity = sum(s.sum() - (s ** 2).sum() / s.sum() for s in sides)
                if best is None or impurity < best[0] - 1e-9 * w.sum():
                    best = (impurity, f, t, *[int(s.argmax()) for s in sides])
        _, f, t, a, b = best
        missed = np.where(x[:, f] <= t, a, b) != y
        e = w[missed].sum() / w.sum()
        if e >= 1 - 1 / k:
            break
        vote = rate * (math.log((1 - e) / e) + math.log(k - 1))
        out.append((f, t, a, b, vote))
        w = w * np.where(missed, math.exp(vote), 1.0)
    return out


def test_boosting_beside_a_plain_one(spark, sliced, monkeypatch):
    """Every stump of every cell, also after votes were written twice."""
    monkeypatch.setattr(boost, "ROUNDS_A_WRITE", 2)
    from pyspark.sql import functions as F
    few = sliced.with_df(sliced.df.select(*[F.floor(F.col(c) * 2).cast("double").alias(c)
                                            if c in sliced.features else F.col(c)
                                            for c in sliced.df.columns]).cache())
    sides = cells_of(few)
    models = {k: BoostClassifier(5 + (k[0] or 0), learning_rate=0.7, max_bins=64) for k in sides}
    fitted = BoostClassifier.fit_cells({k: (models[k], s) for k, s in sides.items()})
    for key, s in sides.items():
        x, labels = matrix(s.rows())
        y = np.unique(labels, return_inverse=True)[1]
        plain = plain_boost(x, y, 3, models[key].n_estimators, 0.7)
        got = [(t.feature, t.threshold, t.left, t.right, t.weight) for t in fitted[key].stumps]
        assert len(got) == len(plain)
        for a, b in zip(got, plain):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])


def test_bins_of_many_values():
    points = np.arange(1000.0)
    cuts = boost._cuts(points, np.ones(1000), 10)
    assert len(cuts) == 9 and np.abs(np.diff(cuts) - 100).max() <= 2
    assert boost._cuts(np.array([3.0, 3.0]), np.ones(2), 10).size == 0
    assert boost._cuts(np.array([1.0, 2.0, 4.0]), np.ones(3), 10).tolist() == [1.5, 3.0]


def test_elimination_by_either_way(sliced, monkeypatch):
    """Warm starts drop what fits from the start drop."""
    from pyspark.sql import functions as F
    from foldwise.operators import reduce
    wide = sliced.rebuild({**sliced.columns(), "n1": F.rand(1), "n2": F.rand(2), "n3": F.rand(3)})
    wide = wide.with_df(wide.df.cache())
    quick = reduce.RecursiveElimination(3).fit(wide).names
    monkeypatch.setattr(reduce, "DRIVER_NUMBERS", 1)
    assert reduce.RecursiveElimination(3).fit(wide).names == quick


def test_packed_rows_give_the_same_sums(clouds):
    from foldwise.models.cells import TrainSide, gather, summed
    from foldwise.operators.folds import FoldPlan, assign_slices
    frame = assign_slices(clouds, FoldPlan(3))
    wide = frame.rebuild({n: frame.columns()[n] for n in frame.features[:2]})
    sides = {"a": TrainSide(frame, (0, 1)), "b": TrainSide(frame, (2,)), "c": TrainSide(wide)}
    found = []
    for packed in (False, True):
        rows = gather(sides, packed=packed)
        found.append(summed(rows, list(sides), lambda key, cell, x, y, v: np.concatenate(
            [[len(x)], x.sum(axis=0), x.T @ (y == 1)])))
        if packed:
            assert rows.df.count() < 20
        rows.release()
    for key in sides:
        assert np.allclose(found[0][key], found[1][key])
