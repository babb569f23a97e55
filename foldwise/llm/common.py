"""Tables, intermediate tables and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.session import scratch_dir

# A side is broadcast only if its counted rows and the counted bytes of its texts are at most
# so many; the other way is a shuffle join with the same result.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, *texts: str) -> tuple[int, int]:
    """How many rows a table has, and how many bytes its text columns."""
    size = [F.coalesce(F.sum(F.octet_length(t)), F.lit(0)) for t in texts]
    row = df.agg(F.count("*").alias("n"), sum(size, F.lit(0)).alias("size")).first()
    return row["n"], row["size"]


def is_small(rows: int, size: int = 0) -> bool:
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """``df``, which was counted to have ``rows`` rows and ``size`` bytes of text, marked for
    broadcast if that is little."""
    return F.broadcast(df) if is_small(rows, size) else df
