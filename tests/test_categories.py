"""Categories of any number, declared categories, and formats by name."""

import pytest
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foldwise.frame import Frame, col
from foldwise.operators import categories
from foldwise.operators.encode import Ladder, OneHot
from foldwise.operators.impute import Impute
from foldwise.sources.formats import known_formats, read_format, register_format
from foldwise.sources.tables import read_table


@pytest.fixture(scope="module")
def many(spark):
    """Value v occurs v times in each of two slices, 11 times in the third."""
    rows = [(s * 1000 + v * 20 + i, v, s) for s in range(2) for v in range(1, 9) for i in range(v)]
    rows += [(5000 + i, 99, 2) for i in range(11)] + [(6000, None, 0)]
    df = spark.createDataFrame(rows, "row_id int, v int, slice int")
    return Frame.of(df.cache(), "row_id", keys=["slice"])


def counts(frame):
    rows = frame.df.collect()
    return {n: sum(r[n] for r in rows) for n in frame.features}


@pytest.mark.parametrize("inline", [1000, 0])
@pytest.mark.parametrize("unknown", ["error", "ignore", "infrequent_if_exist"])
def test_tables_give_what_expressions_give(many, monkeypatch, inline, unknown):
    monkeypatch.setattr(categories, "INLINE_VALUES", inline)
    fitted = OneHot(["v"], max_categories=4, handle_unknown=unknown).fit_cells(many, {"a": [0, 1], "b": [2]})
    train = many.where(col("slice") < 2)
    assert counts(fitted["a"].apply(train)) == {"v_6": 12, "v_7": 14, "v_8": 16,
                                                "v_infrequent_sklearn": 31}
    other = many.where(col("slice") == 2)
    if unknown == "error":
        with pytest.raises(Exception, match="unknown category in 'v': 99"):
            fitted["a"].apply(other).df.collect()
    else:
        lost = 11.0 if unknown == "infrequent_if_exist" else 0.0
        assert counts(fitted["a"].apply(other)) == {"v_6": 0, "v_7": 0, "v_8": 0,
                                                    "v_infrequent_sklearn": lost}
    assert fitted["b"].apply(other).features == ("v_99",)


def test_limits_name_the_way_out(many):
    with pytest.raises(ValueError, match="max_columns"):
        OneHot(["v"], max_columns=3).fit(many)
    with pytest.raises(ValueError, match="max_columns"):
        OneHot(["v"], min_frequency=1, max_columns=3).fit(many)
    assert len(OneHot(["v"], max_columns=10).fit(many).apply(many).features) == 10


def test_declared_categories(many):
    step = OneHot(["v"], categories=[[1, 2, 50]], handle_unknown="ignore")
    assert counts(step.fit(many).apply(many)) == {"v_1": 2, "v_2": 4, "v_50": 0}
    rare = OneHot(["v"], categories=[[1, 2, 8, 50]], min_frequency=3, handle_unknown="infrequent_if_exist")
    assert counts(rare.fit(many).apply(many)) == {"v_2": 4, "v_8": 16, "v_infrequent_sklearn": 64}
    with pytest.raises(ValueError, match="unknown category"):
        OneHot(["v"], categories=[[1, 2]]).fit(many)
    with pytest.raises(ValueError, match="sorted"):
        OneHot(["v"], categories=[[2, 1]]).fit(many)
    with pytest.raises(ValueError, match="one list"):
        OneHot(["v"], categories=[])


def test_categorical_features_of_every_cell(spark):
    """As fitted cell by cell, with a job count that cells don't change."""
    df = spark.range(400).selectExpr("id AS row_id", "CAST(id % 5 AS INT) AS slice", "id % 3 AS a",
                                     "CASE WHEN id % 5 = 0 THEN id ELSE 1 END AS b", "id AS c",
                                     "CAST(NULL AS STRING) AS d")
    frame = Frame.of(df, "row_id", keys=["slice"])
    cells = {k: [s for s in range(5) if s != k] for k in range(5)}
    step = OneHot(max_unique_vals=4)
    fitted = step.fit_cells(frame, cells)
    for k, slices in cells.items():
        alone = step.fit(frame.where(col("slice").isin(slices)))
        assert fitted[k].encoded.keys() == alone.encoded.keys()
        assert fitted[k].encoded["a"].columns == alone.encoded["a"].columns
    assert set(fitted[0].encoded) == {"a", "b", "d"} and set(fitted[1].encoded) == {"a", "d"}

    def jobs():
        return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()

    used = []
    for n in (2, 5):
        before = jobs()
        step.fit_cells(frame, dict(list(cells.items())[:n]))
        used.append(jobs() - before)
    assert used[0] == used[1]


@pytest.mark.parametrize("inline", [1000, 0])
def test_ladder_with_many_other_values(many, monkeypatch, inline):
    monkeypatch.setattr(categories, "INLINE_VALUES", inline)
    fitted = Ladder("v", [1, 8, 99, 5]).fit_cells(many, {0: [0, 1]})[0]
    out = fitted.apply(many.where(col("slice") < 2))
    assert out.features == ("v (1 <- 8)", "v (8 <- 5)")
    assert counts(out) == {"v (1 <- 8)": 26, "v (8 <- 5)": 10}
    with pytest.raises(Exception, match="unknown category"):
        fitted.apply(many).df.collect()


def test_stated_missing_values(spark):
    df = spark.createDataFrame([(1, -1, "a"), (2, 4, "?"), (3, 6, "a"), (4, None, "b")],
                               "row_id int, n int, t string")
    frame = Frame.of(df, "row_id")
    out = Impute(["n"], missing_values=-1, add_indicator=True).fit(frame).apply(frame)
    assert out.features == ("n", "t", "missingindicator_n")
    rows = [(r["n"], r["missingindicator_n"]) for r in out.df.orderBy("row_id").collect()]
    assert rows == [(5.0, 1.0), (4.0, 0.0), (6.0, 0.0), (None, 0.0)]
    out = Impute(["t"], "most_frequent", missing_values="?").fit(frame).apply(frame)
    assert [r["t"] for r in out.df.orderBy("row_id").collect()] == ["a", "a", "a", "b"]
    # Only features with missing values get an indicator; they follow the train side.
    out = Impute(strategy="most_frequent", add_indicator=True).fit(frame).apply(frame)
    assert out.features == ("n", "t", "missingindicator_n")


def test_spellings_of_null(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,whole,number,flag,words,empty\n1,NA,1,True,null,\n2,7,n/a,false,x,NaN\n"
                    "3,-2,2.5e1,None,nano,\n")
    frame = read_table(spark, str(path), index="k")
    assert dict(frame.df.dtypes) == {"k": "int", "whole": "int", "number": "double",
                                     "flag": "boolean", "words": "string", "empty": "double"}
    rows = [tuple(r) for r in frame.df.orderBy("k").collect()]
    assert rows == [(1, None, 1.0, True, None, None), (2, 7, None, False, "x", None),
                    (3, -2, 25.0, None, "nano", None)]
    assert read_table(spark, str(path), index="k", null_values=["x"]).df.where("words = 'null'").count() == 1


def test_formats_by_name(spark):
    # Classes of a function go to the workers as they are.
    class Squares(DataSource):
        """A user's data source: numbers and their squares."""

        @classmethod
        def name(cls):
            return "squares"

        def schema(self):
            return "n int, square int"

        def reader(self, schema):
            return SquaresReader(int(self.options["path"]))

    class SquaresReader(DataSourceReader):
        def __init__(self, n):
            self.n = n

        def partitions(self):
            return [InputPartition(k) for k in range(2)]

        def read(self, partition):
            for n in range(partition.value, self.n, 2):
                yield n, n * n

    register_format("squares", Squares)
    frame = read_format(spark, "squares", "5", "n")
    assert {(r["n"], r["square"]) for r in frame.df.collect()} == {(n, n * n) for n in range(5)}
    numbered = read_format(spark, "squares", "5")
    ids = {r["row_id"]: r["n"] for r in numbered.df.collect()}
    assert ids == {0: 0, 1: 2, 2: 4, 3: 1, 4: 3}
    assert {"squares", "tabular"} <= set(known_formats())
    with pytest.warns(UserWarning, match="replaced"):
        register_format("squares", lambda spark, path: spark.range(int(path)))
    assert read_format(spark, "squares", "3", "id").df.count() == 3
    with pytest.raises(ValueError, match="unknown table format"):
        read_format(spark, "none", "x")
