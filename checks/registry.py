"""Registered queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.frame import Frame, col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(query):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    """The columns as SQL expressions that both engines understand."""
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def sql_view(name: str, columns: dict[str, str]) -> str:
    """The same projection as SQL text."""
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {name}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, as the oracle does."""
    return df.select(*[F.round(col(n), digits).alias(n) if t == "double" else col(n)
                       for n, t in df.dtypes])


def out(frame: Frame, *more: str) -> DataFrame:
    """Row id, features in order, and further keys of a frame."""
    names = [frame.row_id] if frame.row_id in frame.keys else []
    return rounded(frame.df.select(*[col(n) for n in [*names, *more, *frame.features]]))


# No given table holds nulls, so they are made from values.
ORDERS = {
    "row_id": "o_orderkey",
    "label": "o_orderstatus",
    "customer": "o_custkey",
    "price": "CASE WHEN o_totalprice < 60000 THEN NULL ELSE o_totalprice END",
    "priority": "NULLIF(o_orderpriority, '4-NOT SPECIFIED')",
    "year": "CASE WHEN year(o_orderdate) < 1996 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END",
}
ORDERS_SQL = sql_view("orders", ORDERS)

# Events as a log of runs: unique trials, and a step that repeats.
LOG = {
    "run": "event_type",
    "replicate": "user_id",
    "trial": "event_id",
    "step": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
    "objective": "value",
    "score": "round(value / 10)",
    "held_out": "round(value / 12) + extract(hour FROM ts)",
}
LOG_SQL = sql_view("events", LOG)

FOLD_SEED = 71554


def positions_sql(source: str, label: str = "label", row_id: str = "row_id") -> str:
    """The position of every row in (class, seeded order), in plain SQL."""
    return (f"SELECT *, row_number() OVER (ORDER BY {label}, "
            f"md5('{FOLD_SEED}|' || CAST({row_id} AS VARCHAR)), {row_id}) - 1 AS g "
            f"FROM ({source}) src")


def orders(spark: SparkSession, sf_dir: str) -> Frame:
    return Frame.of(view(spark, sf_dir, "orders", ORDERS), "row_id", "label")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events", LOG)
