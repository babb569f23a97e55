"""Queries on sources, sinks and the choice of columns and rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import ORDERS_SQL, check, orders, out, rounded, table
from foldwise.frame import Frame
from foldwise.operators import select as S
from foldwise.session import scratch_dir
from foldwise.sources.formats import known_formats, read_format, register_format
from foldwise.sources.tables import Dump, number_parquet_rows, read_dump, read_table


@check("read_select", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def read_select(spark, sf_dir):
    frame = read_table(spark, f"{sf_dir}/orders.parquet", index="o_orderkey")
    picked = S.select_features(frame, ["o_totalprice", "o_orderpriority"])
    return picked.df


@check("row_key", """
    SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey, c_name FROM customer""")
def row_key(spark, sf_dir):
    return (number_parquet_rows(spark, f"{sf_dir}/customer.parquet")
            .select("row_id", "c_custkey", "c_name"))


@check("delimited_rows", """
    SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_orderpriority
    FROM orders""")
def delimited_rows(spark, sf_dir):
    """Several files, cut into many blocks, numbered in file order."""
    path = scratch_dir(spark, "orders-tsv")
    (table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
     .repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
     .write.option("sep", "\t").option("header", True).csv(path))
    frame = read_table(spark, path, "\t", schema="o_orderkey bigint, o_orderpriority string")
    return frame.df


@check("null_spellings", """
    SELECT o_orderkey, CASE WHEN o_custkey % 9 < 6 THEN CAST(o_custkey AS INT) END AS customer,
           CASE WHEN o_custkey % 5 < 3 THEN round(o_totalprice, 2) END AS price,
           CASE WHEN o_custkey % 4 < 2 THEN o_orderpriority < '3' END AS early,
           CASE WHEN o_custkey % 3 < 2 THEN o_orderpriority END AS priority FROM orders""")
def null_spellings(spark, sf_dir):
    """Missing values as files spell them; the other values still tell the types."""
    path = scratch_dir(spark, "spelled-tsv")
    key = F.col("o_custkey")

    def spelled(value, rest, first, second, *more):
        words = F.array(*map(F.lit, (first, second, *more)))
        return F.when(rest, value.cast("string")).otherwise(words[(key % (2 + len(more))).cast("int")])

    (table(spark, sf_dir, "orders").select(
        "o_orderkey", spelled(key, key % 9 < 6, "NA", "NaN", "n/a").alias("customer"),
        spelled(F.round("o_totalprice", 2), key % 5 < 3, "nan", "NULL", "None").alias("price"),
        spelled(F.col("o_orderpriority") < "3", key % 4 < 2, "null", "#N/A", "<NA>").alias("early"),
        spelled(F.col("o_orderpriority"), key % 3 < 2, "N/A", "-NaN").alias("priority"))
     .write.option("sep", "\t").option("header", True).csv(path))
    return read_table(spark, path, "\t", "o_orderkey").df


def key_values(spark, path: str, separator: str = ";") -> DataFrame:
    """A user's format: lines like ``id=7;segment=BUILDING``."""
    found = F.str_to_map(F.col("value"), F.lit(separator), F.lit("="))
    rows = spark.read.text(path).select(found.alias("m"))
    return rows.select(F.col("m")["id"].cast("bigint").alias("id"), F.col("m")["segment"].alias("segment"),
                       F.col("m")["balance"].cast("double").alias("balance"))


@check("format_rows", """
    SELECT c_custkey AS id, c_mktsegment AS segment, round(c_acctbal, 2) AS balance FROM customer""")
def format_rows(spark, sf_dir):
    """A table in a format that a user registered by name."""
    if "key_values" not in known_formats():
        register_format("key_values", key_values)
    path = scratch_dir(spark, "key-values")
    table(spark, sf_dir, "customer").select(F.concat(
        F.lit("id="), F.col("c_custkey"), F.lit(";segment="), F.col("c_mktsegment"),
        F.lit(";balance="), F.round("c_acctbal", 2).cast("decimal(20,2)"))).write.text(path)
    return rounded(read_format(spark, "key_values", path, "id").df, 2)


@check("set_feature", """
    SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice / 1000, 6) AS o_totalprice,
           o_orderdate, o_orderpriority, o_totalprice > 250000 AS is_large FROM orders""")
def set_feature(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "orders"), "o_orderkey")
    price = F.col("o_totalprice")
    return rounded(S.set_features(frame, {"o_totalprice": price / 1000,
                                          "is_large": price > 250000}).df)


@check("drop_explicit", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def drop_explicit(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "customer"), "c_custkey")
    return S.DropFeatures(["c_name"]).apply(frame).df


@check("keep_explicit", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def keep_explicit(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "customer"), "c_custkey")
    return S.KeepFeatures(["c_mktsegment", "c_acctbal"]).apply(frame).df


@check("isolate_target", """
    SELECT o_orderkey, o_orderstatus AS label, o_custkey, o_totalprice, o_orderdate,
           o_orderpriority FROM orders""")
def isolate_target(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "orders"), "o_orderkey")
    return S.isolate_target(frame, "o_orderstatus").df


@check("sample_select", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def sample_select(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey",
                                                           "o_totalprice"), "o_orderkey")
    returned = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    return S.select_rows(frame, returned, "l_orderkey").df


@check("drop_null_rows", f"""
    SELECT row_id, customer, round(price, 6) AS price, priority, year FROM ({ORDERS_SQL}) t
    WHERE (CASE WHEN customer IS NULL THEN 1 ELSE 0 END) + (CASE WHEN price IS NULL THEN 1 ELSE 0 END)
        + (CASE WHEN priority IS NULL THEN 1 ELSE 0 END) + (CASE WHEN year IS NULL THEN 1 ELSE 0 END)
        < 2""")
def drop_null_rows(spark, sf_dir):
    return out(S.DropSparseRows(0.5).apply(orders(spark, sf_dir)))


@check("drop_null_cols", f"SELECT row_id, customer, round(price, 6) AS price FROM ({ORDERS_SQL}) t")
def drop_null_cols(spark, sf_dir):
    return out(S.DropSparseFeatures(0.15).apply(orders(spark, sf_dir)))


@check("dump_roundtrip", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def dump_roundtrip(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    path = scratch_dir(spark, "dump") + ".tsv"
    frame = Dump(path).apply(Frame.of(customers, "c_custkey", "c_mktsegment"))
    order = [frame.row_id, *frame.features, frame.label]
    schema = ", ".join(f"{n} {dict(customers.dtypes)[n]}" for n in order)
    return read_dump(spark, path, schema)
