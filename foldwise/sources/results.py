"""Results of runs: snapshots of Parquet folders, one row per (replicate, trial).

A run is a folder of data folders and of numbered snapshots. A snapshot names
the data folders that make up the table; the one with the largest number counts.
Appending writes a data folder and then a snapshot with it, overwriting a
snapshot without the old ones: a reader sees the table before or after, never
something between. Small folders are written together now and then; what that
or an overwrite replaces stays for readers that began before, and goes the next
time. One writer at a time: of two, the later raises.
"""

from __future__ import annotations

import json
import math
import uuid
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.frame import col
from foldwise.sources.files import Files

# Data folders of a table after which small ones are written together.
COMPACT_AFTER = 16
# A data file should have about so many bytes.
FILE_BYTES = 128 * 2**20
SNAPSHOTS = "_snapshots"


@dataclass(frozen=True)
class Snapshot:
    """The data folders of a table, and those that it no longer needs."""

    number: int
    folders: tuple[str, ...]
    schema: str
    replaced: tuple[str, ...] = ()


def run_label(study: str, model: str, data: str) -> str:
    return f"{study}__{model}__{data}"


def train_name(metric: str, cross: int) -> str:
    return f"{metric} (train) [{cross}]"


def stage_name(metric: str, stage: str) -> str:
    return f"{metric} ({stage})"


class ResultStore:
    """Typed wide tables under ``path/run=<label>``; other runs are untouched."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    def _folder(self, run: str) -> str:
        return f"{self.path}/run={run}"

    # --- Snapshots -----------------------------------------------------------

    def snapshot(self, run: str) -> Snapshot | None:
        """The current snapshot of a run, or None if there is no such run."""
        folder = f"{self._folder(run)}/{SNAPSHOTS}"
        names = [n for n in self.files.names(folder) if n.endswith(".json") and n[0] != "."]
        if not names:
            return None
        told = json.loads(self.files.read(f"{folder}/{names[-1]}"))
        return Snapshot(int(names[-1][:-5]), tuple(told["folders"]), told["schema"],
                        tuple(told["replaced"]))

    def _publish(self, run: str, snapshot: Snapshot) -> None:
        folder = f"{self._folder(run)}/{SNAPSHOTS}"
        self.files.publish(f"{folder}/{snapshot.number:012d}.json", json.dumps(
            {"folders": snapshot.folders, "schema": snapshot.schema, "replaced": snapshot.replaced}))
        # Older snapshots than these are nobody's any more.
        self.files.delete(f"{folder}/{snapshot.number - 2 * COMPACT_AFTER:012d}.json")

    def _write(self, run: str, rows: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self._folder(run)}/{name}")
        return name

    def _replace(self, run: str, old: Snapshot, folders: tuple[str, ...], schema: str) -> None:
        """A snapshot that drops folders; those that the last such one dropped are deleted."""
        gone = tuple(f for f in old.folders if f not in folders)
        self._publish(run, Snapshot(old.number + 1, folders, schema, gone))
        for name in old.replaced:
            self.files.delete(f"{self._folder(run)}/{name}")

    def _compact(self, run: str, now: Snapshot) -> None:
        sizes = {f: self.files.size(f"{self._folder(run)}/{f}") for f in now.folders}
        small = [f for f in now.folders if sizes[f] < FILE_BYTES]
        if len(small) < 2:
            return
        rows = self._read(run, small, now.schema)
        written = self._write(run, rows.coalesce(max(1, math.ceil(sum(
            sizes[f] for f in small) / FILE_BYTES))))
        self._replace(run, now, (*(f for f in now.folders if f not in small), written), now.schema)

    def _read(self, run: str, folders: list[str] | tuple[str, ...], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self._folder(run)}/{f}" for f in folders])

    # --- Tables --------------------------------------------------------------

    def exists(self, run: str) -> bool:
        return self.snapshot(run) is not None

    def create(self, run: str, schema: T.StructType, overwrite: bool = False) -> None:
        """Start an empty table; one of the same label is an error, or replaced."""
        old = self.snapshot(run)
        if old is None:
            self._publish(run, Snapshot(0, (), schema.json()))
            return
        if not overwrite:
            raise FileExistsError(f"PATH_ALREADY_EXISTS: results of run {run!r}")
        warnings.warn(f"results of run {run!r} are overwritten", stacklevel=2)
        self._replace(run, old, (), schema.json())

    def append(self, run: str, rows: DataFrame) -> None:
        """Add finished trials, columns in the order of the table."""
        now = self._current(run)
        names = T.StructType.fromJson(json.loads(now.schema)).names
        written = self._write(run, rows.select(*[col(n) for n in names]))
        now = Snapshot(now.number + 1, (*now.folders, written), now.schema, now.replaced)
        self._publish(run, now)
        if len(now.folders) > COMPACT_AFTER:
            self._compact(run, now)

    def load(self, run: str) -> DataFrame:
        now = self._current(run)
        return self._read(run, now.folders, now.schema)

    def _current(self, run: str) -> Snapshot:
        now = self.snapshot(run)
        if now is None:
            raise FileNotFoundError(f"no results of run {run!r} in {self.path!r}")
        return now

    def runs(self) -> DataFrame:
        """The labels of all stored runs, empty ones too; reads file names only."""
        labels = [n[4:] for n in self.files.names(self.path) if n.startswith("run=")]
        return self.spark.createDataFrame([(n,) for n in labels], "run string")

    def write_rows(self, run: str, replicate: int, trial: int, rows: DataFrame) -> None:
        """Row-level results of one trial (e.g. the rows predicted right).

        Each trial owns its folder: trials may be written at the same time, and
        one that is run again replaces its rows instead of doubling them.
        """
        rows.write.mode("overwrite").parquet(
            f"{self.path}.rows/run={run}/replicate={replicate}/trial={trial}")

    def load_rows(self, run: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}.rows/run={run}")


def runs_of(log: DataFrame, run: str = "run") -> DataFrame:
    """The distinct runs of one long log table."""
    return log.select(col(run)).distinct()


def run_of(log: DataFrame, label: str, run: str = "run") -> DataFrame:
    """One run of a long log table; the filter reaches the scan."""
    return log.filter(col(run) == label).drop(run)


def repair_types(results: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast metrics that were stored as text; what is no number becomes null."""
    return results.withColumns({n: col(n).try_cast(t) for n, t in types.items()})
