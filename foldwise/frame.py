"""A table with named roles: features, and key columns no transform touches."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A name as SQL text; names may hold dots, spaces or brackets."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its literal name."""
    return F.col(quoted(name))


@dataclass(frozen=True)
class Frame:
    """A DataFrame plus the roles of its columns.

    ``keys`` (row id, label, slice, ...) are carried along unchanged; rows are
    identified by ``row_id``, never by position. Feature order has meaning.
    """

    df: DataFrame
    features: tuple[str, ...]
    keys: tuple[str, ...] = ()
    row_id: str = "row_id"
    label: str = "label"

    @staticmethod
    def of(df: DataFrame, row_id: str | None = None, label: str | None = None,
           keys: Iterable[str] = ()) -> "Frame":
        held = [k for k in (row_id, label, *keys) if k is not None]
        held = tuple(dict.fromkeys(held))
        missing = [k for k in held if k not in df.columns]
        if missing:
            raise ValueError(f"no such column: {missing}")
        features = tuple(c for c in df.columns if c not in held)
        return Frame(df, features, held, row_id or "row_id", label or "label")

    @property
    def n_features(self) -> int:
        return len(self.features)

    def type_of(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def is_numeric(self, name: str) -> bool:
        return isinstance(self.type_of(name), T.NumericType)

    def require(self, names: Iterable[str]) -> list[str]:
        names = list(names)
        missing = [n for n in names if n not in self.features]
        if missing:
            raise KeyError(f"features not in the table: {missing}")
        return names

    def rebuild(self, columns: dict[str, Column]) -> "Frame":
        """One projection that keeps the keys and sets the features."""
        picked = [col(k) for k in self.keys]
        picked += [c.alias(n) for n, c in columns.items()]
        return replace(self, df=self.df.select(*picked), features=tuple(columns))

    def columns(self) -> dict[str, Column]:
        return {n: col(n) for n in self.features}

    def where(self, condition: Column) -> "Frame":
        return replace(self, df=self.df.filter(condition))

    def with_df(self, df: DataFrame) -> "Frame":
        return replace(self, df=df)
