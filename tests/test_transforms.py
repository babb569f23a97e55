import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowers import FLOWER_SCHEMA
from foldwise.frame import Frame, col
from foldwise.operators import select as S
from foldwise.operators.encode import Ladder, OneHot, Ordinal, low_cardinality
from foldwise.operators.impute import Impute
from foldwise.operators.reduce import PrincipalComponents, RecursiveElimination
from foldwise.operators.scale import Scale
from foldwise.sources.tables import Dump, read_dump, read_table

LENGTHS = ["sepal length (cm)", "sepal width (cm)", "petal length (cm)", "petal width (cm)"]


def small(spark, rows, schema, label=None):
    return Frame.of(spark.createDataFrame(rows, f"row_id int, {schema}"), "row_id", label)


def values(frame, name):
    return [r[0] for r in frame.df.orderBy(frame.row_id).select(col(name)).collect()]


# --- Tables ------------------------------------------------------------------

def test_read_delimited_with_index(spark, flower_file):
    frame = read_table(spark, flower_file, "\t", "id", FLOWER_SCHEMA)
    assert frame.row_id == "id" and frame.df.count() == 150
    assert frame.features[0] == "sepal length (cm)"


def test_rows_without_index_get_stable_unique_ids(spark, flower_file):
    frame = read_table(spark, flower_file, "\t")
    ids = [r[0] for r in frame.df.select("row_id").collect()]
    assert len(set(ids)) == 150


def test_parquet_rows_are_numbered_across_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).repartition(5).write.parquet(path)
    ids = sorted(r[0] for r in read_table(spark, path).df.select("row_id").collect())
    assert ids == list(range(100))


def test_missing_file_raises(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_table(spark, "/nowhere/x.csv", schema="a int")


def test_dump_keeps_stages_apart(spark, flowers, tmp_path):
    frame = S.isolate_target(flowers, "target")
    dump = Dump(str(tmp_path / "d.csv"))
    dump.apply(frame.where(F.col("label") == 0), "train")
    dump.apply(frame.where(F.col("label") != 0), "test")
    schema = "id string, a double, b double, c double, d double, e string, f string, g string, y int"
    assert read_dump(spark, str(tmp_path / "d.csv"), schema, "train").count() == 50
    assert read_dump(spark, str(tmp_path / "d.csv"), schema, "test").count() == 100
    with pytest.raises(ValueError):
        Dump("x.json")


# --- Selection ---------------------------------------------------------------

def test_dropping_unknown_or_only_feature_raises(spark):
    one = small(spark, [(1, 2)], "a int")
    with pytest.raises(TypeError):
        S.DropFeatures(["a"]).apply(one)
    with pytest.raises(TypeError):
        S.isolate_target(one, "a")
    with pytest.raises(KeyError):
        S.drop_features(small(spark, [(1, 2, 3)], "a int, b int"), ["c"])


def test_a_feature_may_be_called_label(spark):
    frame = S.isolate_target(small(spark, [(1, "a", 2)], "label string, t int"), "t")
    assert (frame.label, frame.features, frame.keys) == ("t", ("label",), ("row_id", "t"))


def test_keep_follows_the_given_order(flowers):
    assert S.KeepFeatures(["size", "color"]).apply(flowers).features == ("size", "color")


def test_sparse_rows_strict_and_truncating(spark):
    frame = small(spark, [(1, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0), (3, None, None, 1.0),
                          (4, float("nan"), 1.0, 1.0)], "a double, b double, c double")
    assert values(S.DropSparseRows(0.7).apply(frame), "row_id") == [1, 2, 4]
    assert values(S.DropSparseRows(0.5).apply(frame), "row_id") == [1]
    assert values(S.DropSparseRows(0.2).apply(frame), "row_id") == []  # tolerance 0
    with pytest.raises(TypeError):
        S.DropSparseRows(1)


def test_sparse_features_keep_the_boundary(spark):
    frame = small(spark, [(1, None, None), (2, None, None), (3, None, 1.0), (4, 1.0, 1.0)],
                  "a double, b double")
    assert S.DropSparseFeatures(0.5).apply(frame).features == ("b",)
    with pytest.raises(IndexError):
        S.DropSparseFeatures(0.25).apply(frame)


def test_features_overwrite_in_place_and_append(flowers):
    out = S.set_features(flowers, {"color": F.lit("x"), "new": F.lit(1)})
    assert out.features == (*flowers.features, "new")


# --- Imputation and scaling --------------------------------------------------

def test_impute_fills(spark):
    frame = small(spark, [(1, 1.0, "b"), (2, 1.0, "a"), (3, 2.0, "a"), (4, 2.0, "b"),
                          (5, None, None)], "x double, s string")
    assert values(Impute(["x"]).fit(frame).apply(frame), "x")[-1] == 1.5
    assert values(Impute(["x"], "median").fit(frame).apply(frame), "x")[-1] == 1.5
    modes = Impute(strategy="most_frequent").fit(frame).apply(frame)
    assert values(modes, "x")[-1] == 1.0 and values(modes, "s")[-1] == "a"
    fixed = Impute(["s"], "constant").fit(frame).apply(frame)
    assert values(fixed, "s")[-1] == "missing_value" and fixed.features == ("x", "s")


def test_impute_refuses_text_and_empty_columns(spark):
    frame = small(spark, [(1, None, "a")], "x double, s string")
    with pytest.raises(TypeError):
        Impute(["s"]).fit(frame)
    with pytest.raises(ValueError, match="fill value"):
        Impute(["x"]).fit(frame)


def test_most_frequent_orders_numbers_as_numbers(spark):
    frame = small(spark, [(1, 10), (2, 9), (3, None)], "x int")
    assert Impute(["x"], "most_frequent").fit(frame).fills == {"x": 9}


def test_scaling_moves_to_the_end(spark):
    frame = small(spark, [(1, 1.0, 7.0, 3), (2, 2.0, 7.0, 3), (3, 3.0, 7.0, None)],
                  "a double, b double, c int")
    out = Scale(["a", "b"]).fit(frame).apply(frame)
    assert out.features == ("c", "a", "b")
    a = values(out, "a")
    assert a == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    assert values(out, "b") == [0.0, 0.0, 0.0]
    assert values(Scale(["a"], with_mean=False, with_std=False).fit(frame).apply(frame), "a") == [
        1.0, 2.0, 3.0]


def test_noise_around_a_constant_is_not_scaled_up(spark):
    frame = small(spark, [(i, 0.1) for i in range(50)], "a double")
    assert values(Scale().fit(frame).apply(frame), "a") == pytest.approx([0.0] * 50, abs=1e-12)


# --- Encoding ----------------------------------------------------------------

def test_one_hot_with_nulls(flowers):
    out = OneHot(["color"]).fit(flowers).apply(flowers)
    hot = ["color_pink", "color_purple", "color_white", "color_nan"]
    assert out.features[-4:] == tuple(hot) and "color" not in out.features
    joined = flowers.df.select("id", "color").join(out.df.select("id", *hot), "id").collect()
    assert len(joined) == 150
    for r in joined:
        assert [r[h] for h in hot] == [float(h == f"color_{r['color'] or 'nan'}") for h in hot]


def test_one_hot_binary(flowers):
    step = OneHot(["flower_category"], drop="if_binary", handle_unknown="warn")
    out = step.fit(flowers).apply(flowers)
    assert [n for n in out.features if n.startswith("flower")] == ["flower_category_small-flower"]


def test_one_hot_unknown(spark):
    train = small(spark, [(1, "a"), (2, "b")], "s string")
    test = small(spark, [(1, "c")], "s string")
    with pytest.raises(Exception, match="unknown category"):
        OneHot(["s"]).fit(train).apply(test).df.collect()
    assert values(OneHot(["s"], handle_unknown="ignore").fit(train).apply(test), "s_a") == [0.0]


def test_one_hot_drops(spark):
    frame = small(spark, [(1, "a", 1), (2, "b", 2), (3, "c", 2)], "s string, n int")
    for drop, names in (("first", ("s_b", "s_c", "n_2")), (["b", 1], ("s_a", "s_c", "n_2")),
                        ("if_binary", ("s_a", "s_b", "s_c", "n_2"))):
        assert OneHot(["s", "n"], drop=drop).fit(frame).apply(frame).features == names
    with pytest.raises(ValueError, match="not found"):
        OneHot(["s"], drop=["z"]).fit(frame)


def test_one_hot_infrequent(spark):
    rows = [(i, v) for i, v in enumerate("aaaabbbccd")]
    train = small(spark, rows, "s string")
    out = OneHot(["s"], min_frequency=3).fit(train).apply(train)
    assert out.features == ("s_a", "s_b", "s_infrequent_sklearn")
    out = OneHot(["s"], max_categories=2, handle_unknown="infrequent_if_exist").fit(train)
    test = small(spark, [(1, "z"), (2, "a")], "s string")
    assert out.apply(test).features == ("s_a", "s_infrequent_sklearn")
    assert values(out.apply(test), "s_infrequent_sklearn") == [1.0, 0.0]


def test_low_cardinality_is_strict_and_skips_nulls(spark):
    frame = small(spark, [(i, i % 3 if i else None, i % 4, i) for i in range(60)],
                  "a int, b int, c int")
    assert low_cardinality(frame, ["a", "b", "c"], 4) == ["a"]
    out = OneHot(max_unique_vals=4).fit(frame).apply(frame)
    assert out.features == ("b", "c", "a_0", "a_1", "a_2", "a_nan")


def test_ordinal_with_unknowns(flowers):
    order = ["white", "purple", "pink"]
    out = Ordinal(["color"], order, "use_encoded_value", float("nan")).fit(flowers).apply(flowers)
    assert out.features == flowers.features
    joined = flowers.df.select("id", "color").join(
        out.df.select("id", F.col("color").alias("code")), "id").collect()
    for r in joined:
        assert r["code"] == (None if r["color"] is None else float(order.index(r["color"])))


def test_ordinal_refuses_undeclared_values(spark):
    frame = small(spark, [(1, "x")], "s string")
    with pytest.raises(Exception, match="unknown category"):
        Ordinal(["s"], ["a", "b"]).fit(frame).apply(frame).df.collect()
    with pytest.raises(TypeError):
        Ordinal(["s"], None)


def test_ladder_example(spark):
    rows = list(enumerate(["small", "medium", "small", "large", "medium", "small", None]))
    frame = small(spark, rows, "size string")
    out = Ladder("size", ["small", "medium", "large"]).fit(frame).apply(frame)
    assert out.features == ("size (small <- medium)", "size (medium <- large)")
    got = list(zip(values(out, out.features[0]), values(out, out.features[1])))
    assert got == [(0, 0), (1, 0), (0, 0), (1, 1), (1, 0), (0, 0), (0, 0)]


def test_ladder_pools_rare_rungs(spark):
    rows = list(enumerate("aaaabbbccd"))
    frame = small(spark, rows, "s string")
    out = Ladder("s", ["a", "b", "x", "c", "d"], 0.35).fit(frame).apply(frame)
    assert out.features == ("s (a <- b|c|d)",)
    with pytest.raises(ValueError, match="min_frequency"):
        Ladder("s", ["c", "d"], 0.9).fit(frame)
    for bad in ({"order": ["a"]}, {"order": "ab"}, {"order": ["a", "b"], "sparse_output": True}):
        with pytest.raises(ValueError):
            Ladder("s", **bad)
    with pytest.raises(TypeError):
        Ladder("s", ["a", "b"], 1)


def test_ladder_steps_never_rise(flowers):
    out = Ladder("size", ["small", "medium", "large"]).fit(flowers).apply(flowers)
    first, second = (values(out, n) for n in out.features[-2:])
    assert all(a >= b for a, b in zip(first, second))


# --- Fewer features ----------------------------------------------------------

def test_components_equal_an_eigen_solve(clouds):
    out = PrincipalComponents(0.8).fit(clouds).apply(clouds)
    x = np.array([list(r) for r in clouds.df.orderBy("row_id").select(*"abcd").collect()])
    x = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    shares = np.cumsum(s**2) / np.sum(s**2)
    k = int(np.searchsorted(shares, 0.8, side="right")) + 1
    assert out.features == tuple(f"PC{i}" for i in range(k))
    vt = vt * np.sign(vt[range(4), np.abs(vt).argmax(axis=1)])[:, None]
    got = np.array([list(r) for r in out.df.orderBy("row_id").select(*out.features).collect()])
    assert got == pytest.approx(x @ vt[:k].T, abs=1e-9)
    assert out.keys == clouds.keys


def test_components_options(clouds):
    assert len(PrincipalComponents(2).fit(clouds).apply(clouds).features) == 2
    with pytest.raises(ValueError):
        PrincipalComponents(1.5)


def test_elimination_keeps_what_separates(clouds):
    noisy = clouds.rebuild({"noise": F.rand(1) * 0.1, **clouds.columns()})
    fitted = RecursiveElimination(0.6).fit(noisy)
    assert len(fitted.names) == 3 and "noise" not in fitted.names
    assert RecursiveElimination(0.01).keep(5) == 1


def test_elimination_of_one_feature_warns(clouds):
    with pytest.warns(UserWarning):
        assert RecursiveElimination(0.5).fit(S.select_features(clouds, ["a"])).names == ("a",)
