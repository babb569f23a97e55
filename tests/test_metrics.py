import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from foldwise.frame import Frame
from foldwise.operators import metrics as M


@pytest.fixture(scope="module")
def preds(spark):
    rows = [("x", i, y, p, {"0": 1 - s, "1": s}) for i, (y, p, s) in enumerate(
        [(0, 0, .1), (0, 1, .6), (1, 1, .6), (1, 1, .9), (1, 0, .4), (0, 0, .4), (1, 2, .7)])]
    return spark.createDataFrame(
        rows, "cell string, row_id int, label int, pred int, proba map<string,double>")


def test_class_scores_name_their_class(preds):
    precision = M.per_class_map(preds, "precision", ["cell"]).first()["precision"]
    assert precision == pytest.approx({"0": 2 / 3, "1": 2 / 3, "2": 0.0})
    recall = M.per_class_map(preds, "recall", ["cell"]).first()["recall"]
    assert recall == pytest.approx({"0": 2 / 3, "1": 1 / 2, "2": 0.0})


def test_weighted_recall_is_accuracy(preds):
    accuracy = preds.agg(F.avg((F.col("label") == F.col("pred")).cast("int"))).first()[0]
    assert M.weighted_average(preds, "recall", ["cell"]).first()["recall"] == pytest.approx(accuracy)


def test_balanced_accuracy_ignores_classes_absent_from_truth(preds):
    assert M.balanced_accuracy(preds, ["cell"]).first()[1] == pytest.approx((2 / 3 + 1 / 2) / 2)


def test_auc_equals_pair_counting_and_mirrors(preds):
    rows = preds.collect()
    pos = [r["proba"]["1"] for r in rows if r["label"] == 1]
    neg = [r["proba"]["1"] for r in rows if r["label"] == 0]
    wins = sum((p > n) + (p == n) / 2 for p, n in product(pos, neg)) / len(pos) / len(neg)
    assert M.roc_auc(preds, ["cell"]).first()["roc_auc"] == pytest.approx(wins)
    score, hit = F.col("proba")["1"], F.col("label") == 1
    up = M.roc_auc(preds, [], score, hit).first()["roc_auc"]
    down = M.roc_auc(preds, [], -score, hit).first()["roc_auc"]
    assert up + down == pytest.approx(1.0)


def test_auc_needs_two_classes(preds):
    three = preds.withColumn("proba", F.map_concat("proba", F.create_map(F.lit("2"), F.lit(0.0))))
    with pytest.raises(Exception, match="two classes"):
        M.roc_auc(three, ["cell"]).collect()


def test_log_loss_of_an_unseen_class_is_finite(preds):
    loss = M.log_loss(preds.withColumn("label", F.lit(9)), ["cell"]).first()["log_loss"]
    assert loss == pytest.approx(-math.log(M.EPSILON))


def test_rows_split_into_right_and_wrong(preds):
    right = {r["row_id"] for r in M.correct_rows(preds).collect()}
    wrong = {r["row_id"] for r in M.incorrect_rows(preds).collect()}
    assert right == {0, 2, 3, 5} and wrong == {1, 4, 6}


def test_many_metrics_in_one_table(preds):
    found = M.evaluate(preds, ["cell"], ["log_loss", "sk_f1_perclass", "mine"],
                       {"mine": lambda p, by: p.groupBy(*by).agg(F.count("*").alias("mine"))})
    rows = {r["metric"]: r for r in found.collect()}
    assert rows["mine"]["value"] == 7.0 and set(rows["sk_f1_perclass"]["classes"]) == {"0", "1", "2"}


@pytest.mark.parametrize("bucket_rows", [10**6, 100])
def test_importance_finds_the_feature_in_use(spark, bucket_rows):
    class Sign:
        def predict(self, frame):
            return frame.df.select(*frame.keys, (F.col("x") > 0).cast("int").alias("pred"))

    df = spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"),
        (F.col("id") % 2 - 0.5).alias("x"), F.rand(1).alias("noise"))
    rows = M.permutation_importance(Sign(), Frame.of(df, "row_id", "label"),
                                    bucket_rows=bucket_rows).collect()
    assert [r["feature"] for r in rows] == ["x", "noise"]
    assert 0.4 < rows[0]["importance"] < 0.6 and rows[1]["importance"] == 0.0
