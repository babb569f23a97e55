"""Queries on fitted transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import ORDERS_SQL, check, orders, out, positions_sql, rounded, table
from foldwise.frame import Frame, col
from foldwise.functions.hashing import uniform
from foldwise.operators.base import apply_cells
from foldwise.operators.encode import Ladder, OneHot, Ordinal, low_cardinality
from foldwise.operators.folds import FoldPlan, assign_slices, side
from foldwise.operators.impute import Impute
from foldwise.operators.reduce import PrincipalComponents, RecursiveElimination
from foldwise.operators.scale import Scale
from foldwise.operators.select import DropSparseFeatures, DropSparseRows
from foldwise.plans.pipeline import Pipeline, Run, fit_cells
from foldwise.sources.tables import stored

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _imputed(fills: str, price: str, priority: str, year: str) -> str:
    return (f"WITH t AS ({ORDERS_SQL}), f AS ({fills}) SELECT row_id, customer, "
            f"round({price}, 6) AS price, {priority} AS priority, {year} AS year FROM t, f")


@check("impute_mean", _imputed(
    "SELECT avg(price) AS p, avg(year) AS y FROM t", "coalesce(price, p)", "priority",
    "round(coalesce(CAST(year AS DOUBLE), y), 6)"))
def impute_mean(spark, sf_dir):
    frame = orders(spark, sf_dir)
    return out(Impute(["price", "year"]).fit(frame).apply(frame))


@check("impute_median", _imputed(
    "SELECT median(price) AS p, median(year) AS y FROM t", "coalesce(price, p)", "priority",
    "round(coalesce(CAST(year AS DOUBLE), y), 6)"))
def impute_median(spark, sf_dir):
    frame = orders(spark, sf_dir)
    return out(Impute(["price", "year"], strategy="median").fit(frame).apply(frame))


@check("impute_mode", _imputed(
    """SELECT (SELECT priority FROM t WHERE priority IS NOT NULL GROUP BY priority
               ORDER BY count(*) DESC, priority LIMIT 1) AS m,
              (SELECT year FROM t WHERE year IS NOT NULL GROUP BY year
               ORDER BY count(*) DESC, year LIMIT 1) AS y""",
    "price", "coalesce(priority, m)", "coalesce(year, y)"))
def impute_mode(spark, sf_dir):
    frame = orders(spark, sf_dir)
    return out(Impute(["priority", "year"], strategy="most_frequent").fit(frame).apply(frame))


@check("impute_constant", _imputed(
    "SELECT 1", "coalesce(price, 0)", "coalesce(priority, 'missing_value')", "coalesce(year, 0)"))
def impute_constant(spark, sf_dir):
    frame = orders(spark, sf_dir)
    return out(Impute(strategy="constant").fit(frame).apply(frame))


def _scaled(name: str, mean: bool = True) -> str:
    top = f"({name} - avg({name}) OVER ())" if mean else name
    return (f"round({top} / CASE WHEN stddev_pop({name}) OVER () = 0 THEN 1 "
            f"ELSE stddev_pop({name}) OVER () END, 6) AS {name}")


@check("scale_all", f"SELECT {', '.join(_scaled(n) for n in NUMBERS)} FROM lineitem")
def scale_all(spark, sf_dir):
    # No column of lineitem identifies a row; scaling needs none.
    frame = Frame.of(table(spark, sf_dir, "lineitem").select(*NUMBERS))
    return out(Scale().fit(frame).apply(frame))


@check("scale_no_mean", f"""
    SELECT c_custkey, c_name, c_nationkey, c_mktsegment, {_scaled('c_acctbal', mean=False)}
    FROM customer""")
def scale_no_mean(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "customer"), "c_custkey")
    return out(Scale(["c_acctbal"], with_mean=False).fit(frame).apply(frame))


def _hot(feature: str, value: str, name: str | None = None) -> str:
    test = f"{feature} IS NULL" if value is None else f"coalesce({feature} = '{value}', FALSE)"
    return f"CAST({test} AS DOUBLE) AS \"{feature}_{name or value or 'nan'}\""


@check("onehot", f"""
    SELECT o_orderkey, o_custkey, {', '.join(_hot('o_orderpriority', p) for p in PRIORITIES)}
    FROM orders""")
def onehot(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", "o_custkey"), "o_orderkey")
    return out(OneHot(["o_orderpriority"]).fit(frame).apply(frame))


KNOWN = [p for p in PRIORITIES if p != "4-NOT SPECIFIED"]


@check("onehot_null", f"""
    SELECT row_id, customer, round(price, 6) AS price, year,
           {', '.join(_hot('priority', p) for p in [*KNOWN, None])} FROM ({ORDERS_SQL}) t""")
def onehot_null(spark, sf_dir):
    frame = orders(spark, sf_dir)
    return out(OneHot(["priority"]).fit(frame).apply(frame))


@check("onehot_if_binary", """
    SELECT l_quantity, CAST(l_linestatus = 'O' AS DOUBLE) AS "l_linestatus_O",
           CAST(l_returnflag = 'A' AS DOUBLE) AS "l_returnflag_A",
           CAST(l_returnflag = 'N' AS DOUBLE) AS "l_returnflag_N",
           CAST(l_returnflag = 'R' AS DOUBLE) AS "l_returnflag_R" FROM lineitem""")
def onehot_if_binary(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_quantity", "l_returnflag"))
    step = OneHot(["l_linestatus", "l_returnflag"], drop="if_binary", handle_unknown="warn")
    return out(step.fit(frame).apply(frame))


@check("onehot_min_frequency", """
    WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name),
         rare AS (SELECT p_name FROM c
                  WHERE n < 0.016 * (SELECT count(*) FROM part)),
         long AS (SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM rare)
                         THEN 'p_name_infrequent_sklearn' ELSE 'p_name_' || p_name END AS name
                  FROM part)
    SELECT p_partkey, name, CAST(1 AS DOUBLE) AS value FROM long""")
def onehot_min_frequency(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    wide = OneHot(["p_name"], min_frequency=0.016).fit(frame).apply(frame)
    # In long form, as which names are frequent depends on the data.
    long = wide.df.select("p_partkey", F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), col(n).alias("value")) for n in wide.features
    ])).alias("e")).select("p_partkey", "e.name", "e.value")
    return long.filter(F.col("value") != 0)


def _long(frame: Frame) -> DataFrame:
    """(row id, name) of the 0/1 columns that are 1: which there are depends on the data."""
    long = frame.df.select(col(frame.row_id), F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), col(n).alias("value")) for n in frame.features])).alias("e"))
    return long.where("e.value = 1").select(frame.row_id, "e.name")


@check("onehot_max_categories", """
    WITH c AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey DESC) AS place
               FROM orders GROUP BY o_custkey)
    SELECT o_orderkey, 'o_custkey_' || CASE WHEN place < 6 THEN CAST(o.o_custkey AS VARCHAR)
                                            ELSE 'infrequent_sklearn' END AS name
    FROM orders o JOIN c ON c.o_custkey = o.o_custkey""")
def onehot_max_categories(spark, sf_dir):
    """More categories than an expression can hold: the five most frequent reach the driver."""
    frame = Frame.of(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return _long(OneHot(["o_custkey"], max_categories=6).fit(frame).apply(frame))


@check("onehot_folds", f"""
    WITH t AS (SELECT o_orderkey, o_custkey, g % 3 AS fold FROM ({positions_sql(
        "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders", "o_orderstatus", "o_orderkey")}) p),
    n AS (SELECT replicate, o_custkey, count(*) AS n FROM t, (SELECT unnest(range(3)) AS replicate) r
          WHERE fold <> replicate GROUP BY replicate, o_custkey),
    c AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY n DESC, o_custkey DESC) AS place
          FROM n)
    SELECT o_orderkey, replicate, 'o_custkey_' || CASE WHEN place < 4 THEN CAST(t.o_custkey AS VARCHAR)
           ELSE 'infrequent_sklearn' END AS name
    FROM t JOIN c ON c.o_custkey = t.o_custkey AND c.replicate = t.fold""")
def onehot_folds(spark, sf_dir):
    """The held-out rows of each fold, by the categories of its training rows; values that
    those lack have no 1 at all."""
    frame = Frame.of(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
    plan = FoldPlan(3)
    frame = assign_slices(frame, plan)
    step = OneHot(["o_custkey"], max_categories=4, handle_unknown="ignore")
    fitted = step.fit_cells(frame, {r: plan.in_group(r) for r in range(3)})
    return reduce(DataFrame.unionByName, [
        _long(f.apply(side(frame, plan.out_group(r)))).withColumn("replicate", F.lit(r))
        for r, f in fitted.items()])


@check("onehot_given", f"""
    SELECT row_id, customer, round(price, 6) AS price, year,
           {', '.join(_hot('priority', p) for p in ['5-LOW', None, '1-URGENT'])}
    FROM ({ORDERS_SQL}) t""")
def onehot_given(spark, sf_dir):
    """Declared categories, in their order; other values have no column."""
    frame = orders(spark, sf_dir)
    step = OneHot(["priority"], categories=[["5-LOW", None, "1-URGENT"]], handle_unknown="ignore")
    return out(step.fit(frame).apply(frame))


@check("impute_marked", """
    WITH t AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size END AS size,
                      p_retailprice AS price FROM part),
    m AS (SELECT avg(size) FILTER (WHERE size <> -1) AS size FROM t)
    SELECT p_partkey, round(CASE WHEN t.size = -1 THEN m.size ELSE t.size END, 6) AS size,
           round(price, 6) AS price, CAST(t.size = -1 AS DOUBLE) AS missingindicator_size FROM t, m""")
def impute_marked(spark, sf_dir):
    """A number that stands for missing values, and a column that tells where it stood."""
    df = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size END AS size",
        "p_retailprice AS price")
    frame = Frame.of(df, "p_partkey")
    step = Impute(strategy="mean", missing_values=-1, add_indicator=True)
    return out(step.fit(frame).apply(frame))


@check("categorical_folds", f"""
    WITH t AS (SELECT *, g % 4 AS fold FROM ({positions_sql(
        "SELECT * FROM part", "p_type", "p_partkey")}) p),
    d AS (SELECT replicate, feature, count(DISTINCT v) AS n FROM (
            SELECT fold, unnest(['p_name', 'p_brand', 'p_size', 'p_retailprice']) AS feature,
                   unnest([p_name, p_brand, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)]) AS v
            FROM t) l, (SELECT unnest(range(4)) AS replicate) r WHERE fold <> replicate GROUP BY ALL)
    SELECT replicate, feature, n FROM d WHERE n < 60""")
def categorical_folds(spark, sf_dir):
    """The categorical features of each train side, all found together; their category counts."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_brand", "p_size",
                                             "p_retailprice")
    plan = FoldPlan(4)
    frame = assign_slices(Frame.of(df, "p_partkey", "p_type"), plan)
    fitted = OneHot(max_unique_vals=60).fit_cells(frame, {r: plan.in_group(r) for r in range(4)})
    rows = [(r, n, len(c.known)) for r, f in fitted.items() for n, c in f.encoded.items()]
    return spark.createDataFrame(rows, "replicate int, feature string, n bigint")


@check("detect_categorical", """
    WITH d AS (SELECT 'p_name' AS feature, count(DISTINCT p_name) AS n FROM part
        UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part
        UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
        UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part
        UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice) FROM part)
    SELECT p.p_type, d.feature, count(*) AS n_rows FROM part p, d WHERE d.n < 30
    GROUP BY p.p_type, d.feature""")
def detect_categorical(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "part"), "p_partkey")
    found = low_cardinality(frame, list(frame.features), 30)
    return (frame.df.select("p_type", F.explode(F.array(*[F.lit(n) for n in found]))
                            .alias("feature"))
            .groupBy("p_type", "feature").agg(F.count(F.lit(1)).alias("n_rows")))


def _codes(feature: str, order: list[str], unknown: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(order))
    return f"CAST(CASE {feature} {whens} ELSE {unknown} END AS DOUBLE)"


@check("ordinal", f"""
    SELECT o_orderkey, {_codes('o_orderpriority', PRIORITIES)} AS o_orderpriority, o_custkey
    FROM orders""")
def ordinal(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", "o_custkey"), "o_orderkey")
    return out(Ordinal(["o_orderpriority"], PRIORITIES).fit(frame).apply(frame))


@check("ordinal_unknown", f"""
    SELECT row_id, customer, round(price, 6) AS price,
           CASE WHEN priority IS NULL THEN NULL
                ELSE {_codes('priority', ['5-LOW', '3-MEDIUM', '2-HIGH'], '-1')} END AS priority,
           year FROM ({ORDERS_SQL}) t""")
def ordinal_unknown(spark, sf_dir):
    frame = orders(spark, sf_dir)
    step = Ordinal(["priority"], ["5-LOW", "3-MEDIUM", "2-HIGH"],
                   handle_unknown="use_encoded_value", unknown_value=-1)
    return out(step.fit(frame).apply(frame))


def _rungs(feature: str, groups: list[list[str]]) -> str:
    parts = []
    for j in range(1, len(groups)):
        up = ", ".join(f"'{v}'" for g in groups[j:] for v in g)
        name = f"{feature} ({'|'.join(groups[j - 1])} <- {'|'.join(groups[j])})"
        parts.append(f"CAST(coalesce({feature} IN ({up}), FALSE) AS INT) AS \"{name}\"")
    return ", ".join(parts)


@check("ladder", f"""
    SELECT row_id, customer, round(price, 6) AS price, year,
           {_rungs('priority', [[p] for p in reversed(KNOWN)])} FROM ({ORDERS_SQL}) t""")
def ladder(spark, sf_dir):
    frame = orders(spark, sf_dir)
    return out(Ladder("priority", list(reversed(KNOWN))).fit(frame).apply(frame))


@check("ladder_min_frequency", f"""
    SELECT p_partkey, p_size, {_rungs('p_type', [['SMALL', 'MEDIUM'],
                                                 ['STANDARD', 'LARGE', 'PROMO']])} FROM part""")
def ladder_min_frequency(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"),
                     "p_partkey")
    step = Ladder("p_type", ["SMALL", "MEDIUM", "STANDARD", "LARGE", "PROMO"], 0.3, "ignore")
    return out(step.fit(frame).apply(frame))


def held_out(step, frame: Frame, plan: FoldPlan) -> Frame:
    """Every row as transformed by the fit that did not see it, in one pass."""
    fitted = fit_cells(step, frame, {r: plan.in_group(r) for r in range(plan.replicates)})
    return apply_cells(fitted, frame, plan.replicate_column())


@check("fit_train_apply_test", f"""
    WITH t AS ({positions_sql(ORDERS_SQL)}),
         s AS (SELECT r.replicate, avg(t.price) AS a, stddev_pop(t.price) AS d
               FROM t JOIN (SELECT DISTINCT CAST(g % 5 AS INT) AS replicate FROM t) r
                 ON t.g % 5 <> r.replicate GROUP BY r.replicate)
    SELECT row_id, customer, priority, year, round((price - a) / d, 6) AS price, s.replicate
    FROM t JOIN s ON t.g % 5 = s.replicate""")
def fit_train_apply_test(spark, sf_dir):
    plan = FoldPlan(5)
    frame = assign_slices(orders(spark, sf_dir), plan)
    return rounded(held_out(Scale(["price"]), frame, plan).df.select(
        "row_id", "customer", "priority", "year", "price",
        plan.replicate_column().alias("replicate")))


@check("median_per_fold", f"""
    WITH t AS ({positions_sql(ORDERS_SQL)}),
         s AS (SELECT r.replicate, median(t.price) AS m
               FROM t JOIN (SELECT DISTINCT CAST(g % 5 AS INT) AS replicate FROM t) r
                 ON t.g % 5 <> r.replicate GROUP BY r.replicate)
    SELECT row_id, round(coalesce(price, m), 6) AS price, s.replicate
    FROM t JOIN s ON t.g % 5 = s.replicate""")
def median_per_fold(spark, sf_dir):
    plan = FoldPlan(5)
    frame = stored(assign_slices(orders(spark, sf_dir), plan), "slices")
    filled = held_out(Impute(["price"], strategy="median"), frame, plan)
    return rounded(filled.df.select("row_id", "price",
                                    plan.replicate_column().alias("replicate")))


# The stages a transform runs at, for each pair of flags.
_PREPARED = f"""
    WITH t AS (SELECT row_id, price, g FROM ({positions_sql(ORDERS_SQL)}) p),
    n AS (SELECT row_id, price, r.replicate, CAST((row_number() OVER (
                 PARTITION BY r.replicate ORDER BY g) - 1) % 2 AS INT) AS "cross"
          FROM t, (SELECT DISTINCT CAST(g % 2 AS INT) AS replicate FROM t) r
          WHERE g % 2 <> r.replicate),
    a AS (SELECT replicate, avg(price) AS m FROM n GROUP BY replicate),
    b AS (SELECT x.replicate, x."cross", avg(n.price) AS m
          FROM (SELECT DISTINCT replicate, "cross" FROM n) x
          JOIN n ON n.replicate = x.replicate AND n."cross" <> x."cross"
          GROUP BY x.replicate, x."cross"),
    f AS (SELECT * FROM (VALUES (TRUE, FALSE), (TRUE, TRUE), (FALSE, TRUE), (FALSE, FALSE))
          v(per_replicate, per_cross))
    SELECT n.row_id, n.replicate, n."cross", f.per_replicate, f.per_cross,
           round(CASE WHEN n.price IS NOT NULL THEN n.price
                      WHEN f.per_replicate THEN a.m
                      WHEN f.per_cross THEN b.m END, 6) AS price
    FROM n JOIN a ON a.replicate = n.replicate
           JOIN b ON b.replicate = n.replicate AND b."cross" = n."cross" CROSS JOIN f"""


@check("stage_gate", _PREPARED)
def stage_gate(spark, sf_dir):
    plan = FoldPlan(2, 2)
    frame = orders(spark, sf_dir).rebuild({"price": col("price")})
    frame = assign_slices(frame, plan)
    parts = []
    for per_replicate, per_cross in ((True, False), (True, True), (False, True), (False, False)):
        pipeline = Pipeline.of({"post_split_hooks": [
            {"type": "imputation_simple", "run_per_replicate": per_replicate,
             "run_per_cross": per_cross}]})
        fits: dict = {}
        for r in range(plan.replicates):
            run = Run(r, lambda step: step.options, fits)
            inside, _ = pipeline.split(side(frame, plan.in_group(r)),
                                       side(frame, plan.out_group(r)), "replicate", run)
            for x in range(plan.crosses):
                run = Run((r, x), lambda step: step.options, fits)
                _, test = pipeline.split(side(inside, plan.cross_train(r, x)),
                                         side(inside, plan.cross_test(r, x)), "cross", run)
                parts.append(test.df.select(
                    "row_id", F.lit(r).alias("replicate"), F.lit(x).alias("cross"),
                    F.lit(per_replicate).alias("per_replicate"),
                    F.lit(per_cross).alias("per_cross"), "price"))
    return rounded(reduce(DataFrame.unionByName, parts))


@check("pca_project")
def pca_project(spark, sf_dir):
    frame = Frame.of(table(spark, sf_dir, "lineitem").select(*NUMBERS))
    frame = Scale().fit(frame).apply(frame)
    return out(PrincipalComponents(0.7).fit(frame).apply(frame))


_TOTAL = " + ".join(f"var_pop({n})" for n in NUMBERS)


@check("pca_variance", f"""
    SELECT 'features' AS side, round(({_TOTAL}) / 1000000, 4) AS variance,
           CAST(0 AS DOUBLE) AS centre FROM lineitem
    UNION ALL SELECT 'components', round(({_TOTAL}) / 1000000, 4), 0 FROM lineitem""")
def pca_variance(spark, sf_dir):
    """All components together hold the variance of the features, around 0."""
    frame = Frame.of(table(spark, sf_dir, "lineitem").select(*NUMBERS))
    parts = PrincipalComponents(len(NUMBERS)).fit(frame).apply(frame)

    def spread(f: Frame, name: str, centre) -> DataFrame:
        total = sum((F.var_pop(n) for n in f.features), F.lit(0.0)) / 1_000_000
        return f.df.agg(F.round(total, 4).alias("variance"), centre.alias("centre")
                        ).select(F.lit(name).alias("side"), "variance", "centre")

    means = sum((F.avg(n) for n in parts.features), F.lit(0.0))
    return spread(frame, "features", F.max(F.lit(0.0))).unionByName(
        spread(parts, "components", F.abs(F.round(means, 4))))


@check("pca_covariances", f"""
    SELECT i, j, TRUE AS apart, CASE WHEN i = 0 AND j = 1 THEN (
             SELECT round({' + '.join(f'var_pop({n})' for n in NUMBERS)}, 3) FROM lineitem) END AS total
    FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) WHERE i < j""")
def pca_covariances(spark, sf_dir):
    """Components vary apart from each other, the first ones most, and keep the total variance."""
    df = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"),
        *[F.col(n).cast("double").alias(n) for n in NUMBERS])
    frame = Frame.of(df, "row_id")
    out = PrincipalComponents(4).fit(frame).apply(frame)
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    found = out.df.agg(*[F.covar_pop(f"PC{i}", f"PC{j}").alias(f"c{i}{j}") for i, j in pairs],
                       *[F.var_pop(f"PC{i}").alias(f"v{i}") for i in range(4)])
    total = sum((F.col(f"v{i}") for i in range(1, 4)), F.col("v0"))
    return found.select(F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(j).alias("j"),
        ((F.abs(F.col(f"c{i}{j}")) < 1e-6 * total) & (F.col(f"v{i}") >= F.col(f"v{j}"))).alias("apart"),
        (F.round(total, 3) if (i, j) == (0, 1) else F.lit(None).cast("double")).alias("total"))
        for i, j in pairs])).alias("e")).select("e.*")


@check("rfe_planted", "SELECT 'l_quantity' AS kept")
def rfe_planted(spark, sf_dir):
    """Of a column that decides the label and two of noise, the first is kept."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_quantity", uniform(1, F.col("l_orderkey"), F.col("l_linenumber")).alias("noise"),
        uniform(2, F.col("l_orderkey"), F.col("l_linenumber")).alias("more_noise"),
        (F.col("l_quantity") > 25).cast("int").alias("large"))
    frame = Frame.of(lines, None, "large")
    frame = Scale().fit(frame).apply(frame)
    kept = RecursiveElimination(1).fit(frame).apply(frame).features
    return frame.df.select(F.explode(F.array(*[F.lit(n) for n in kept])).alias("kept")).distinct()


@check("rfe_select")
def rfe_select(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*NUMBERS, "l_linenumber", "l_returnflag")
    frame = Frame.of(lines, None, "l_returnflag")
    frame = Scale().fit(frame).apply(frame)
    return out(RecursiveElimination(0.6).fit(frame).apply(frame), "l_returnflag")


@check("custom_transform", """
    SELECT c_custkey, c_name, c_nationkey, c_mktsegment,
           round(c_acctbal - min(c_acctbal) OVER (), 6) AS c_acctbal FROM customer""")
def custom_transform(spark, sf_dir):
    class FromLeast:
        """A user's transform: a fit that returns an object with ``apply``."""

        def fit(self, frame):
            least = frame.df.agg(F.min("c_acctbal")).first()[0]

            class Fitted:
                def apply(self, frame):
                    return frame.rebuild({**frame.columns(),
                                          "c_acctbal": col("c_acctbal") - F.lit(least)})
            return Fitted()

    frame = Frame.of(table(spark, sf_dir, "customer"), "c_custkey")
    pipeline = Pipeline.of({"pre_split_hooks": [{"type": "from_least"}]},
                           {"from_least": FromLeast})
    return out(pipeline.prepare(frame, "replicate", Run("all", lambda s: s.options, {})))


_FLAGSHIP = f"""
    WITH kept AS (
      SELECT row_id, label, customer, price FROM ({ORDERS_SQL}) o
      WHERE (CASE WHEN customer IS NULL THEN 1 ELSE 0 END)
          + (CASE WHEN price IS NULL THEN 1 ELSE 0 END) < 1),
    t AS ({positions_sql('SELECT * FROM kept')}),
    s AS (SELECT r.replicate, avg(customer) AS mc, stddev_pop(customer) AS sc,
                 avg(price) AS mp, stddev_pop(price) AS sp
          FROM t JOIN (SELECT DISTINCT CAST(g % 5 AS INT) AS replicate FROM t) r
            ON t.g % 5 <> r.replicate GROUP BY r.replicate)
    SELECT row_id, label, s.replicate, round((customer - mc) / sc, 6) AS customer,
           round((price - mp) / sp, 6) AS price FROM t JOIN s ON t.g % 5 = s.replicate"""


@check("clean_split_scale", _FLAGSHIP)
def clean_split_scale(spark, sf_dir):
    """Drop sparse columns and rows, fold, impute and scale without leakage."""
    plan = FoldPlan(5)
    frame = DropSparseFeatures(0.15).apply(orders(spark, sf_dir))
    frame = stored(assign_slices(DropSparseRows(0.5).apply(frame), plan), "slices")
    pipeline = Pipeline.of({"post_split_hooks": [{"type": "imputation_simple"},
                                                 {"type": "standard_scaling"}]})
    fits: dict = {}
    runs = [Run(r, lambda step: step.options, fits) for r in range(plan.replicates)]
    pipeline.fit_ahead(frame, "replicate", {r: plan.in_group(r.cell) for r in runs})
    for step in pipeline.after:
        own = {r.cell: fits[r.key(step, "replicate")] for r in runs}
        frame = apply_cells(own, frame, plan.replicate_column())
    return rounded(frame.df.select("row_id", "label", plan.replicate_column().alias("replicate"),
                                   "customer", "price"))
