import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwise.frame import Frame
from foldwise.functions.ordered import class_positions, exact_medians, running_totals
from foldwise.operators.folds import FoldPlan, assign_slices, nested_folds, side
from foldwise.operators.impute import Impute
from foldwise.operators.scale import Scale


@pytest.fixture(scope="module")
def rows(spark):
    # Class "a" holds most rows.
    df = spark.range(1000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") < 700, "a").when(F.col("id") < 950, "b").otherwise("c").alias("label"),
        (F.col("id") * 1.5).alias("x"))
    return Frame.of(df, "row_id", "label")


def test_folds_partition_rows_evenly(rows):
    plan = FoldPlan(7)
    found = assign_slices(rows, plan).df.groupBy(
        "label", plan.replicate_column().alias("fold")).count().collect()
    for label in "abc":
        sizes = [r["count"] for r in found if r["label"] == label]
        assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    totals = [sum(r["count"] for r in found if r["fold"] == f) for f in range(7)]
    assert sum(totals) == 1000 and max(totals) - min(totals) <= 1


def test_nested_folds_equal_numbering_within_each_in_group(rows):
    plan = FoldPlan(3, 4)
    placed = class_positions(rows.df, "label", "row_id", 71554).collect()
    got = {(r["row_id"], r["replicate"]): r["cross"]
           for r in nested_folds(assign_slices(rows, plan), plan).collect()}
    assert len(got) == 2000
    for r in range(3):
        inside = sorted((p["position"], p["row_id"]) for p in placed if p["position"] % 3 != r)
        for place, (_, row_id) in enumerate(inside):
            assert got[row_id, r] == place % 4


def test_slices_of_a_plan_agree_with_its_columns():
    plan = FoldPlan(4, 3)
    for r in range(4):
        assert sorted(plan.in_group(r) + plan.out_group(r)) == list(plan.slices)
        tests = [plan.cross_test(r, x) for x in range(3)]
        assert sorted(s for t in tests for s in t) == plan.in_group(r)
        for x in range(3):
            assert not set(plan.cross_train(r, x)) & set(plan.cross_test(r, x))


def test_buckets_do_not_change_positions(rows):
    one = class_positions(rows.df, "label", "row_id", 1)
    many = class_positions(rows.df, "label", "row_id", 1, bucket_rows=5)
    assert one.exceptAll(many).count() == 0 and many.count() == 1000


def test_small_classes_warn_and_tiny_tables_raise(spark):
    df = spark.createDataFrame([(i, "a" if i < 9 else "b") for i in range(10)],
                               "row_id int, label string")
    with pytest.warns(UserWarning, match="fewer than"):
        assign_slices(Frame.of(df, "row_id", "label"), FoldPlan(3))
    with pytest.raises(ValueError, match="no class"):
        assign_slices(Frame.of(df, "row_id", "label"), FoldPlan(10))
    with pytest.raises(ValueError):
        FoldPlan(1)


def test_no_train_statistic_depends_on_test_rows(rows):
    plan = FoldPlan(4)
    frame = assign_slices(rows, plan)
    out = plan.out_group(1)
    spoiled = frame.with_df(frame.df.withColumn(
        "x", F.when(F.col("slice").isin(out), 1e9).otherwise(F.col("x"))))
    for step in (Scale(["x"]), Impute(["x"], "median"), Impute(["x"], "most_frequent")):
        cells = {1: plan.in_group(1)}
        assert step.fit_cells(frame, cells) == step.fit_cells(spoiled, cells)


@pytest.mark.parametrize("step", [Scale(["x"]), Impute(["x"]), Impute(["x"], "median"),
                                  Impute(["x"], "most_frequent")])
def test_fitting_all_cells_at_once_equals_fitting_each(rows, step):
    plan = FoldPlan(3, 2)
    frame = assign_slices(rows, plan)
    cells = {(r, x): plan.cross_train(r, x) for r in range(3) for x in range(2)}
    together = step.fit_cells(frame, cells)
    for key in ((0, 0), (2, 1)):
        alone = step.fit(side(frame, cells[key]))
        a, b = ((f.fills if isinstance(step, Impute) else f.factors)["x"]
                for f in (together[key], alone))
        assert a == pytest.approx(b)


@pytest.mark.parametrize("values", [
    "id * 1.0", "CASE WHEN id % 2 = 0 THEN 1.0 ELSE 2.0 END", "CAST(id % 3 AS DOUBLE)",
    "CASE WHEN id % 3 = 0 THEN 5.0 WHEN id % 3 = 1 THEN 6.0 ELSE id * 1.0 END",
    "CASE WHEN id % 5 > 0 THEN exp(id % 97) END", "-1.0 * id * id", "CAST(NULL AS DOUBLE)"])
@pytest.mark.parametrize("n", [10_000, 9_999, 1])
def test_exact_medians_by_bracketing(spark, values, n):
    df = spark.range(n).selectExpr(f"CAST({values} AS DOUBLE) AS v")
    expected = df.agg(F.median("v")).first()[0]
    found = exact_medians(df, {"v": F.col("v")}, limit=10, accuracy=50)
    assert found == {(None, "v"): expected}


def test_exact_medians_of_many_masks_and_columns(spark, monkeypatch):
    import foldwise.functions.ordered as O
    df = spark.range(3000).selectExpr("id", "CAST(id % 11 AS DOUBLE) AS a",
                                      "CASE WHEN id % 3 > 0 THEN sqrt(id) END AS b")
    masks = {k: F.col("id") % 7 != k for k in range(7)}
    columns = {"a": F.col("a"), "b": F.col("b")}
    expected = {(k, c): df.filter(m).agg(F.median(c)).first()[0]
                for k, m in masks.items() for c in columns}
    assert exact_medians(df, columns, masks) == expected
    monkeypatch.setattr(O, "SERIES_PER_JOB", 4)
    assert exact_medians(df, columns, masks, limit=40, accuracy=100) == expected


def test_running_totals_in_ranges_equal_one_window(spark):
    df = spark.range(500).selectExpr("nullif(id % 3, 0) AS g", "CAST(id AS DOUBLE) AS v",
                                     "id % 7 AS n")
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    one = df.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    many = running_totals(df, ["g"], "v", {"n": "before"})
    assert one.exceptAll(many).count() == 0 and many.count() == 500


def test_running_totals_keep_nulls_and_large_numbers(spark):
    big = 2**53
    df = spark.createDataFrame([(None, 5), *[(big + k, 1) for k in range(8)]], "v bigint, n int")
    got = running_totals(df.repartition(4), [], "v", {"n": "before"}).orderBy("v").collect()
    assert [(r["v"], r["before"]) for r in got] == [
        (None, 0), *[(big + k, 5 + k) for k in range(8)]]


def test_many_classes_as_few(spark, monkeypatch):
    """Starts of classes from a table give the positions that listed ones give."""
    from foldwise.functions import ordered
    rows = spark.range(500).selectExpr("id AS row_id", "concat('c', id % 7) AS label")
    few = class_positions(rows, "label", "row_id", 3).collect()
    monkeypatch.setattr(ordered, "LISTED", 3)
    for size in (10, 10**6):
        many = class_positions(rows, "label", "row_id", 3, bucket_rows=size).collect()
        assert sorted(map(tuple, many)) == sorted(map(tuple, few))
    sizes = ordered.ClassSizes.of(rows, "label", 72)
    assert (sizes.classes, sizes.largest, sizes.small, sizes.some[:2]) == (7, 72, 4, ("c3", "c4"))
    with pytest.raises(ValueError, match="nulls"):
        ordered.ClassSizes.of(rows.selectExpr("row_id", "nullif(label, 'c1') AS label"), "label")


def test_numbering_broadcasts_no_rows(spark):
    """However small the files of the rows look, they are not sent through the driver."""
    from pyspark.sql import functions as F

    from foldwise.functions.ordered import class_positions
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("label"))
    placed = class_positions(df, "label", "id", 7, bucket_rows=20)
    assert placed.select("position").distinct().count() == 1000
    plan = placed._jdf.queryExecution().executedPlan().toString()
    joins = plan[plan.index("SortMergeJoin"):]
    assert "BroadcastHashJoin" not in plan[:plan.index("SortMergeJoin")] and "__h" in joins
