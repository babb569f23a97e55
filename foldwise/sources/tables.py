"""Read and write tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.frame import Frame, col
from foldwise.operators.select import nan_to_null
from foldwise.session import scratch_dir

ROW_ID = "row_id"
MAX_BROADCAST_FILES = 100_000
# The suffixes a dump may have.
SEPARATORS = {".csv": ",", ".tsv": "\t"}
# The spellings of missing values that users of such files expect.
NULL_SPELLINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                  "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_WHOLE = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"


def read_table(spark: SparkSession, path: str, separator: str = ",", index: str | None = None,
               schema: T.StructType | str | None = None,
               null_values: Sequence[str] = NULL_SPELLINGS) -> Frame:
    """A delimited file with a header, or Parquet if the path ends in it.

    ``index`` names the row id; without one, rows are numbered in file order.
    Fields spelled as one of ``null_values`` are null; of the others, columns of
    whole numbers, numbers, and true and false are typed, the rest is text.
    Give a schema for large delimited files: inferring one reads them twice.
    """
    if path.rstrip("/").endswith(".parquet"):
        if index is None:
            return nan_to_null(Frame.of(number_parquet_rows(spark, path), ROW_ID))
        return nan_to_null(Frame.of(spark.read.parquet(path), index))
    df = read_delimited(spark, path, separator, schema, null_values)
    if index is None:
        df, index = number_rows(df), ROW_ID
    return nan_to_null(Frame.of(df, index))


def read_delimited(spark: SparkSession, path: str, separator: str = ",",
                   schema: T.StructType | str | None = None,
                   null_values: Sequence[str] = NULL_SPELLINGS) -> DataFrame:
    """The rows of a delimited file with a header; a field that does not fit its type is null."""
    reader = spark.read.option("sep", separator).option("header", True)
    if schema is not None:
        kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in kinds]))
    text = reader.csv(path)
    # Rows are read as text, so that spellings of null are known before types are.
    spelled = [F.when(~F.trim(col(c)).isin(list(null_values)), F.trim(col(c))) for c in text.columns]
    if schema is None:
        kinds = _inferred(text, spelled)
    whole = {f.name: f.dataType for f in kinds}
    return text.select(*[
        (F.when(~F.trim(col(c)).isin(list(null_values)), col(c)) if whole[c] == T.StringType()
         else own.try_cast(whole[c])).alias(c)
        for c, own in zip(text.columns, spelled)])


def _inferred(text: DataFrame, spelled: list) -> T.StructType:
    """The narrowest type of each column that all its fields fit, in one job."""
    tests = {"int": lambda c: c.rlike(_WHOLE) & c.try_cast("int").isNotNull(),
             "bigint": lambda c: c.rlike(_WHOLE) & c.try_cast("bigint").isNotNull(),
             "double": lambda c: c.rlike(_NUMBER),
             "boolean": lambda c: F.lower(c).isin("true", "false")}
    found = text.agg(*[F.bool_and(F.when(c.isNotNull(), test(c))).alias(f"{kind}{i}")
                       for i, c in enumerate(spelled) for kind, test in tests.items()]).first()
    fields = []
    for i, name in enumerate(text.columns):
        # A column without any value is a column of numbers.
        kind = next((k for k in tests if found[f"{k}{i}"]), "string")
        if found[f"double{i}"] is None:
            kind = "double"
        fields.append(T.StructField(name, T._parse_datatype_string(kind)))
    return T.StructType(fields)


def number_parquet_rows(spark: SparkSession, path: str, out: str = ROW_ID) -> DataFrame:
    """Number rows 0..n-1 in file order: no shuffle, the same on every run.

    Parquet tells each row's place in its file; a running total over the files
    (one row per file) does the rest.
    """
    df = spark.read.parquet(path)
    located = df.select("*", F.col("_metadata.file_path").alias("__file"),
                        F.col("_metadata.row_index").alias("__at"))
    files = located.groupBy(F.col("__file").alias("__path")).agg((F.max("__at") + 1).alias("__n"))
    few = files.limit(MAX_BROADCAST_FILES + 1).collect()
    if len(few) <= MAX_BROADCAST_FILES:
        # Proven small: the rows stay where they are.
        ends = list(accumulate(r["__n"] for r in sorted(few)))
        starts = [(r["__path"], end - r["__n"]) for r, end in zip(sorted(few), ends)]
        starts = F.broadcast(spark.createDataFrame(starts, "__path string, __start bigint"))
    else:
        before = Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)
        starts = files.select("__path",
                              F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = located.join(starts, F.col("__file") == F.col("__path"))
    return joined.select((F.col("__start") + F.col("__at")).alias(out),
                         *[col(c) for c in df.columns])


def number_rows(df: DataFrame, out: str = ROW_ID) -> DataFrame:
    """Number the rows of delimited files 0..n-1 in file order.

    A row's place is that of its file and block, then its place in the block,
    however files are cut into blocks and blocks dealt to tasks. Rows are
    written down once with a running number, which is gapless inside a block;
    a running total over the blocks (one row each) does the rest.
    """
    path = scratch_dir(df.sparkSession, "row-ids")
    (df.select("*", F.col("_metadata.file_path").alias("__file"),
               F.col("_metadata.file_block_start").alias("__block"),
               F.monotonically_increasing_id().alias("__at")).write.parquet(path))
    rows = df.sparkSession.read.parquet(path)
    blocks = rows.groupBy("__file", "__block").agg(F.min("__at").alias("__least"),
                                                   F.count("*").alias("__n"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("__file").alias("__f"), F.col("__block").alias("__b"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).alias("__shift"))
    joined = rows.join(blocks, (F.col("__file") == F.col("__f"))
                       & (F.col("__block") == F.col("__b")))
    return joined.select((F.col("__at") + F.col("__shift")).alias(out),
                         *[col(c) for c in df.columns])


def number_rows_of_any(df: DataFrame, out: str = ROW_ID) -> DataFrame:
    """Number the rows of any table 0..n-1, in the order of its partitions.

    Rows are written down once with a running number, so the numbers don't
    change when the table is read again; a running total over the partitions
    (one row each) closes the gaps between them.
    """
    path = scratch_dir(df.sparkSession, "row-ids")
    place = F.monotonically_increasing_id()
    (df.select("*", place.alias("__at"), F.shiftright(place, 33).alias("__part"))
     .write.parquet(path))
    rows = df.sparkSession.read.parquet(path)
    parts = rows.groupBy("__part").agg(F.min("__at").alias("__least"), F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("__part").alias("__p"), (
        F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).alias("__shift"))
    joined = rows.join(parts, F.col("__part") == F.col("__p"))
    return joined.select((F.col("__at") + F.col("__shift")).alias(out), *[col(c) for c in df.columns])


def stored(frame: Frame, name: str) -> Frame:
    """Write the frame to the shared scratch folder and read it back.

    Cuts the lineage: later jobs start from files that outlive any executor.
    """
    path = scratch_dir(frame.df.sparkSession, name)
    frame.df.write.parquet(path)
    return frame.with_df(frame.df.sparkSession.read.parquet(path))


class Dump:
    """Write features, target and row id to delimited files; pass data on.

    Each stage (e.g. train, test) gets its own ``stage=`` folder, so no stage
    overwrites another.
    """

    def __init__(self, output_dest: str = "./dumped.tsv"):
        suffix = output_dest[output_dest.rfind("."):] if "." in output_dest else ""
        if suffix not in SEPARATORS:
            raise ValueError(f"a dump must end in one of {sorted(SEPARATORS)}: {output_dest!r}")
        self.path, self.separator = output_dest, SEPARATORS[suffix]

    def apply(self, frame: Frame, stage: str = "all") -> Frame:
        order = [frame.row_id] if frame.row_id in frame.keys else []
        order += list(frame.features)
        order += [frame.label] if frame.label in frame.keys else []
        (frame.df.select(*[col(n) for n in order]).write.mode("overwrite")
         .option("sep", self.separator).option("header", True)
         .csv(f"{self.path}/stage={stage}"))
        return frame


def read_dump(spark: SparkSession, path: str, schema: T.StructType | str,
              stage: str = "all") -> DataFrame:
    separator = SEPARATORS[path[path.rfind("."):]]
    return (spark.read.option("sep", separator).option("header", True).schema(schema)
            .csv(f"{path}/stage={stage}"))
