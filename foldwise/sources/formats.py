"""Table formats by name: built-in ones, and those a user registers.

A format is a function ``(spark, path, **options) -> DataFrame``, or a class of
Spark's Python data source API. The data spec's ``format`` picks one.
"""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from foldwise.frame import Frame
from foldwise.operators.select import nan_to_null
from foldwise.sources.tables import ROW_ID, number_rows_of_any, read_table

Reader = Callable[..., DataFrame]
# Fixed value: the name of delimited files in data specs.
TABULAR = "tabular"
_FORMATS: dict[str, Reader | type[DataSource]] = {}


def register_format(name: str, reader: Reader | type[DataSource]) -> None:
    """Make a format known by name; one of the same name is replaced with a warning."""
    if name == TABULAR or name in _FORMATS:
        warnings.warn(f"table format {name!r} is replaced", stacklevel=2)
    _FORMATS[name] = reader


def known_formats() -> list[str]:
    return sorted({TABULAR, *_FORMATS})


def read_format(spark: SparkSession, name: str, path: str, index: str | None = None,
                **options) -> Frame:
    """A table in a format, with the column ``index`` or running numbers as row id."""
    reader = _FORMATS.get(name)
    if reader is None:
        if name != TABULAR:
            raise ValueError(f"unknown table format {name!r}; known are {known_formats()}")
        return read_table(spark, path, index=index, **options)
    if inspect.isclass(reader) and issubclass(reader, DataSource):
        spark.dataSource.register(reader)
        df = spark.read.format(reader.name()).options(**options).load(path)
    else:
        df = reader(spark, path, **options)
    if index is None:
        df, index = number_rows_of_any(df), ROW_ID
    return nan_to_null(Frame.of(df, index))
