"""Snapshots of results: whole for every reader, few files."""

import os

import pytest

from foldwise.sources import results
from foldwise.sources.results import ResultStore

SCHEMA = "replicate int, trial int, objective double"


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, str(tmp_path / "results"))


def rows(spark, *trials):
    return spark.createDataFrame([(0, t, t / 2) for t in trials], SCHEMA)


def trials(df):
    return sorted(r["trial"] for r in df.collect())


def files(store):
    return [os.path.join(d, f) for d, _, names in os.walk(store.path) for f in names]


def test_many_appends_leave_few_files(spark, store, monkeypatch):
    monkeypatch.setattr(results, "COMPACT_AFTER", 5)
    schema = rows(spark).schema
    for run in ("a", "b"):
        store.create(run, schema)
        for t in range(25):
            store.append(run, rows(spark, t).coalesce(1))
    assert trials(store.load("a")) == trials(store.load("b")) == list(range(25))
    data = [f for f in files(store) if f.endswith(".parquet")]
    assert len(data) <= 2 * 3 * 5
    assert len([f for f in files(store) if f.endswith(".json")]) <= 2 * 11
    assert sorted(r[0] for r in store.runs().collect()) == ["a", "b"]


def test_readers_see_old_or_new_rows(spark, store):
    """A table that was opened before an overwrite still has its rows, one opened after none."""
    store.create("a", rows(spark).schema)
    store.append("a", rows(spark, 1, 2))
    before = store.load("a")
    with pytest.warns(UserWarning, match="overwritten"):
        store.create("a", rows(spark).schema, overwrite=True)
    after = store.load("a")
    store.append("a", rows(spark, 7))
    assert trials(before) == [1, 2] and trials(after) == [] and trials(store.load("a")) == [7]


def test_an_append_that_fails_changes_nothing(spark, store, monkeypatch):
    store.create("a", rows(spark).schema)
    store.append("a", rows(spark, 1))

    def fail(self, run, snapshot):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(ResultStore, "_publish", fail)
        with pytest.raises(OSError, match="lost"):
            store.append("a", rows(spark, 2))
    assert trials(store.load("a")) == [1]
    store.append("a", rows(spark, 3))
    assert trials(store.load("a")) == [1, 3]


def test_the_later_of_two_writers_raises(spark, store):
    store.create("a", rows(spark).schema)
    old = store.snapshot("a")
    store.append("a", rows(spark, 1))
    with pytest.raises(FileExistsError):
        store._publish("a", results.Snapshot(old.number + 1, (), old.schema))
    assert trials(store.load("a")) == [1]


def test_columns_follow_the_table(spark, store):
    store.create("a", rows(spark).schema)
    store.append("a", rows(spark, 4).select("objective", "trial", "replicate"))
    assert store.load("a").collect()[0] == (0, 4, 2.0)
    with pytest.raises(FileNotFoundError, match="no results"):
        store.load("none")
    assert not store.exists("none")
