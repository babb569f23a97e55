"""Queries on folds and seeds."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from checks.registry import check, positions_sql, table
from foldwise.frame import Frame
from foldwise.functions.hashing import derived_seed
from foldwise.operators.folds import FoldPlan, assign_slices, nested_folds

VECTORS_SQL = "SELECT vec_id AS row_id, label FROM embeddings"
EVENTS_SQL = "SELECT event_id AS row_id, event_type AS label FROM events"


def _vectors(spark, sf_dir) -> Frame:
    return Frame.of(table(spark, sf_dir, "embeddings").selectExpr("vec_id AS row_id", "label"),
                    "row_id", "label")


def _events(spark, sf_dir) -> Frame:
    return Frame.of(table(spark, sf_dir, "events").selectExpr(
        "event_id AS row_id", "event_type AS label"), "row_id", "label")


@check("replicate_folds", f"""
    SELECT row_id, label, CAST(g % 10 AS INT) AS fold FROM ({positions_sql(VECTORS_SQL)}) p""")
def replicate_folds(spark, sf_dir):
    plan = FoldPlan(10)
    frame = assign_slices(_vectors(spark, sf_dir), plan)
    return frame.df.select("row_id", "label", plan.replicate_column().alias("fold"))


@check("nested_folds", f"""
    WITH t AS ({positions_sql(EVENTS_SQL)})
    SELECT row_id, label, r.replicate, CAST((row_number() OVER (
             PARTITION BY r.replicate ORDER BY g) - 1) % 4 AS INT) AS "cross"
    FROM t JOIN (SELECT DISTINCT CAST(g % 3 AS INT) AS replicate FROM t) r
      ON t.g % 3 <> r.replicate""")
def nested(spark, sf_dir):
    plan = FoldPlan(3, 4)
    frame = assign_slices(_events(spark, sf_dir), plan)
    return nested_folds(frame, plan).select("row_id", "label", "replicate", "cross")


@check("nested_folds_bucketed", f"""
    WITH t AS ({positions_sql(EVENTS_SQL)})
    SELECT row_id, label, CAST(g % 12 AS INT) AS slice FROM t""")
def nested_folds_bucketed(spark, sf_dir):
    """The same numbers when a class is cut into many buckets."""
    frame = assign_slices(_events(spark, sf_dir), FoldPlan(3, 4), bucket_rows=64)
    return frame.df.select("row_id", "label", "slice")


@check("fold_class_counts", f"""
    SELECT label, CAST(g % 10 AS INT) AS fold, count(*) AS n
    FROM ({positions_sql(EVENTS_SQL)}) p GROUP BY label, g % 10""")
def fold_class_counts(spark, sf_dir):
    plan = FoldPlan(10)
    frame = assign_slices(_events(spark, sf_dir), plan)
    return (frame.df.groupBy("label", plan.replicate_column().alias("fold"))
            .agg(F.count(F.lit(1)).alias("n")))


@check("replicate_seeds", """
    SELECT c_custkey AS replicate, CAST(CAST('0x' || substr(md5('71554|' ||
             CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 2147483648 AS INT) AS seed
    FROM customer""")
def replicate_seeds(spark, sf_dir):
    """One seed per replicate; here every customer is a replicate."""
    keys = table(spark, sf_dir, "customer").selectExpr("c_custkey AS replicate")
    return keys.select("replicate", derived_seed(71554, F.col("replicate")).alias("seed"))


@check("folds_many_classes", f"""
    SELECT row_id, label, g % 6 AS slice FROM ({positions_sql(
        "SELECT DISTINCT l_orderkey * 8 + l_linenumber AS row_id, l_orderkey AS label FROM lineitem")}) p""")
def folds_many_classes(spark, sf_dir):
    """As many classes as orders: sizes and starts of classes stay a table."""
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS row_id", "l_orderkey AS label").distinct()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # most classes have few rows
        frame = assign_slices(Frame.of(df, "row_id", "label"), FoldPlan(2, 3))
    return frame.df.select("row_id", "label", "slice")
