"""What must raise, and what must not depend on partitions, sizes or order."""

from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foldwise.frame import Frame, col
from foldwise.models.base import training_set
from foldwise.models.linear import LogisticClassifier
from foldwise.models.neighbors import NeighborsClassifier
from foldwise.models.svm import SupportVectorClassifier
from foldwise.models import BoostClassifier, ForestClassifier
from foldwise.operators.encode import Ladder, OneHot
from foldwise.operators.folds import FoldPlan, assign_slices
from foldwise.operators.impute import Impute
from foldwise.plans.study import Study
from foldwise.sources.results import ResultStore
from foldwise.sources.tables import read_table


def small(spark, rows, schema, label=None):
    return Frame.of(spark.createDataFrame(rows, f"row_id int, {schema}"), "row_id", label)


@pytest.mark.parametrize("step", [
    OneHot(["c"]), Ladder("c", ["a", "b", "z"])])
def test_no_output_can_be_read_without_the_check(spark, step):
    train = small(spark, [(0, "a"), (1, "b"), (2, "z")], "c string")
    out = step.fit(train).apply(small(spark, [(0, "unknown")], "c string"))
    for name in out.features:
        with pytest.raises(Exception, match="unknown category"):
            out.df.select(col(name)).collect()


def test_constants_fit_their_type(spark):
    flags = small(spark, [(0, True), (1, None)], "f boolean")
    with pytest.raises(TypeError, match="boolean"):
        Impute(["f"], "constant").fit(flags)
    filled = Impute(["f"], "constant", False).fit(flags).apply(flags)
    assert {r["f"] for r in filled.df.collect()} == {True, False}
    with pytest.raises(TypeError, match="number"):
        Impute(["x"], "constant", "gone").fit(small(spark, [(0, None)], "x double"))


def test_decimals_are_ordered_as_numbers(spark):
    rows = [(i, Decimal(v)) for i, v in enumerate(["10.00", "9.00", "100.00"])]
    frame = small(spark, rows, "d decimal(10,2)")
    assert list(OneHot(["d"]).fit(frame).apply(frame).features) == ["d_9.00", "d_10.00", "d_100.00"]


@pytest.mark.parametrize("model", [
    LogisticClassifier(None), NeighborsClassifier(3), ForestClassifier(5), BoostClassifier(3),
    SupportVectorClassifier("linear", max_iter=5)])
def test_models_know_their_features(clouds, model):
    fitted = model.fit(clouds)
    turned = replace(clouds, features=tuple(reversed(clouds.features)))
    same = fitted.predict(clouds).join(
        fitted.predict(turned).withColumnRenamed("pred", "other"), "row_id")
    assert same.where("pred != other").count() == 0
    with pytest.raises(ValueError, match="trained on"):
        fitted.predict(replace(clouds, features=clouds.features[:-1]))


def test_no_parameter_is_lowered_silently(clouds):
    with pytest.raises(ValueError, match="max_depth"):
        ForestClassifier(max_depth=31)
    with pytest.raises(ValueError, match="max_features"):
        ForestClassifier(2, max_features=9).fit(clouds)


def test_class_weights_help_the_rare_class(spark):
    """Overlapping classes, 1 in 20: balanced weights find more of the rare one."""
    rows = [(i, int(i % 20 == 0), float(i % 7 + 3 * (i % 20 == 0)), float(i % 11))
            for i in range(1000)]
    frame = small(spark, rows, "label int, a double, b double", "label")

    def found(model):
        return model.fit(frame).predict(frame).where("label = 1 AND pred = 1").count()

    for kind, options in ((ForestClassifier, {"n_estimators": 10, "max_depth": 3}),
                          (SupportVectorClassifier, {"kernel": "linear"})):
        assert found(kind(**options, class_weight="balanced")) > found(kind(**options))
        assert found(kind(**options, class_weight={1: 30.0})) > found(kind(**options))
    with pytest.raises(ValueError, match="no class"):
        ForestClassifier(2, class_weight={7: 1.0}).fit(frame)


@pytest.mark.parametrize("options", [
    {"kernel": "poly", "degree": 2, "coef0": 1.0, "gamma": 0.5}, {"kernel": "rbf", "gamma": "auto"}])
def test_support_vector_options(clouds, options):
    got = SupportVectorClassifier(**options, max_iter=20).fit(clouds).predict(clouds)
    assert got.agg(F.avg((F.col("pred") == F.col("label")).cast("int"))).first()[0] > 0.8


def test_training_rows_do_not_pull_the_scan_into_few_tasks(clouds):
    spread = clouds.with_df(clouds.df.repartition(24))
    plan = training_set(spread).df._jdf.queryExecution().toString()
    assert "Repartition 24, true" in plan and "Repartition 1, true" in plan


def test_folds_of_delimited_files_do_not_depend_on_blocks(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS n", "id % 3 AS c", "repeat('x', 20) AS t")
    rows.repartitionByRange(3, "n").sortWithinPartitions("n").write.option(
        "header", True).csv(f"{tmp_path}/t")
    found = []
    for size in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            frame = read_table(spark, f"{tmp_path}/t")
            frame = replace(frame, features=("n", "t"), keys=("row_id", "c"), label="c")
            sliced = assign_slices(frame, FoldPlan(3, 2)).df
            found.append(sorted(tuple(r) for r in sliced.select("n", "row_id", "slice").collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and [r[0] for r in found[0]] == [r[1] for r in found[0]]


STUDY = {"label": "s", "target": "label", "objective": "log_loss", "no_replicates": 3,
         "no_crosses": 2, "no_trials": 1, "metrics": {"test": ["balanced_accuracy"]}}


def test_choices_are_built_before_any_job():
    model = {"label": "m", "model": "SVC", "parameters": {
        "kernel": {"type": "categorical", "choices": ["linear", "sigmoid"]}}}
    with pytest.raises(ValueError, match="kernel"):
        Study({"label": "d"}, model, STUDY)


def test_failing_replicate_leaves_the_others_and_dump_holds_each_row_once(
        spark, clouds, tmp_path, monkeypatch):
    broken, whole = [True], Study._trial

    def trial(self, frame, store, replicate, *rest):
        if broken and replicate == 1:
            raise RuntimeError("replicate 1 fails")
        return whole(self, frame, store, replicate, *rest)

    monkeypatch.setattr(Study, "_trial", trial)
    data = {"label": "d", "pre_split_hooks": [
        {"type": "dump", "output_dest": f"{tmp_path}/rows.csv"}]}
    model = {"label": "m", "model": "KNNC", "parameters": {"n_neighbors": 3}}
    study, store = Study(data, model, STUDY), ResultStore(spark, f"{tmp_path}/results")
    clouds = replace(clouds, features=(*clouds.features, "label"), keys=("row_id",))
    with pytest.raises(RuntimeError, match="replicate 1"):
        study.run(spark, store, clouds)
    assert {r["replicate"] for r in store.load(study.run_name).collect()} == {0, 2}
    assert spark.read.option("header", True).csv(f"{tmp_path}/rows.csv").count() == 300
    broken.clear()
    assert study.run(spark, store, clouds, resume=True).count() == 3
