"""Queries on models, importance, parameter search and a whole study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import FOLD_SEED, LOG_SQL, check, positions_sql, rounded, run_log, table
from foldwise.frame import Frame
from foldwise.models import (BoostClassifier, EstimatorClassifier, ForestClassifier,
                             LogisticClassifier, NeighborsClassifier, SupportVectorClassifier)
from foldwise.models.cells import TrainSide
from foldwise.models.linear import LogisticClassifier as Logistic
from foldwise.operators.encode import OneHot
from foldwise.operators.folds import FoldPlan, assign_slices, side
from foldwise.operators.metrics import FeatureMetric, evaluate, permutation_importance, with_features
from foldwise.operators.scale import Scale
from foldwise.plans.proposals import propose
from foldwise.plans.space import Space
from foldwise.plans.study import Study
from foldwise.session import scratch_dir
from foldwise.sources.results import ResultStore
from foldwise.sources.tables import stored

DIMENSIONS = 64


def embeddings(spark, sf_dir) -> Frame:
    df = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label",
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMENSIONS)])
    return Frame.of(df, "row_id", "label")


def texts(spark, sf_dir) -> Frame:
    """Shape of a document as features, its quality as label."""
    body = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(body, r"\s+")).cast("double").alias("n_words"),
        F.size(F.split(body, "\n")).cast("double").alias("n_lines"),
        F.length(F.regexp_replace(body, "[^0-9]", "")).cast("double").alias("n_digits"),
        F.length(F.regexp_replace(body, "[^A-Z]", "")).cast("double").alias("n_capitals"))
    rated = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    frame = Frame.of(rated, "doc_id", "quality")
    frame = OneHot(["lang"]).fit(frame).apply(frame)
    return Scale().fit(frame).apply(frame)


def out_of_fold(model, frame: Frame, plan: FoldPlan) -> DataFrame:
    """Every row predicted by the model that did not see it."""
    # Used by every fit: number the rows once and write them down.
    frame = stored(assign_slices(frame, plan), "slices")
    return reduce(DataFrame.unionByName, [
        model.fit(side(frame, plan.in_group(r))).predict(side(frame, plan.out_group(r)))
        .withColumn("replicate", F.lit(r)) for r in range(plan.replicates)])


K = 5
_NEAREST = f"""
    WITH t AS (SELECT row_id, label, x, g % 5 AS fold FROM ({positions_sql(
        "SELECT vec_id AS row_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings")}) p),
    d AS (SELECT a.row_id, a.label, b.label AS voted, row_number() OVER (
            PARTITION BY a.row_id ORDER BY round(list_distance(a.x, b.x), 9), b.row_id) AS n
          FROM t a JOIN t b ON a.fold <> b.fold),
    v AS (SELECT row_id, label, voted, count(*) AS votes FROM d WHERE n <= {K}
          GROUP BY row_id, label, voted)"""


@check("knn_predict", _NEAREST + """
    SELECT row_id, label, voted AS pred FROM (
      SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, voted) AS place
      FROM v) w WHERE place = 1""")
def knn_predict(spark, sf_dir):
    preds = out_of_fold(NeighborsClassifier(K), embeddings(spark, sf_dir), FoldPlan(5))
    return preds.select("row_id", "label", "pred")


@check("knn_proba", _NEAREST + f"""
    SELECT row_id, label, CAST(voted AS VARCHAR) AS class, round(votes / {K}.0, 6) AS p FROM v""")
def knn_proba(spark, sf_dir):
    """The same by routing rows between cells instead of a broadcast."""
    model = NeighborsClassifier(K, broadcast_bytes=0)
    preds = out_of_fold(model, embeddings(spark, sf_dir), FoldPlan(5))
    long = preds.select("row_id", "label", F.explode("proba").alias("class", "p"))
    return rounded(long.filter(F.col("p") > 0))


def _fit_and_predict(model, spark, sf_dir) -> DataFrame:
    preds = out_of_fold(model, texts(spark, sf_dir), FoldPlan(2))
    return rounded(preds.select("doc_id", "quality", "pred",
                                F.element_at("proba", "1").alias("p"), "replicate"))


@check("logreg_predict")
def logreg_predict(spark, sf_dir):
    return _fit_and_predict(LogisticClassifier("elasticnet", l1_c=1.0, l2_c=1.0), spark, sf_dir)


@check("logreg_gradient", """
    SELECT 'lang_' || lang AS feature, TRUE AS at_minimum FROM documents GROUP BY lang
    UNION ALL SELECT unnest(['n_chars', 'n_words', 'n_lines', 'n_digits', 'n_capitals',
                             'intercept']), TRUE""")
def logreg_gradient(spark, sf_dir):
    """C * sum of (p - y) x + w vanishes at the fitted weights, over all rows."""
    frame = texts(spark, sf_dir)
    fitted = LogisticClassifier("l2", l2_c=1.0).fit(frame)
    weights = [*fitted.model.coefficients.toArray(), 0.0]
    scored = fitted.predict(frame).select("doc_id", F.element_at("proba", "1").alias("p"))
    rows = frame.df.join(scored, "doc_id").withColumn("intercept", F.lit(1.0))
    names = [*frame.features, "intercept"]
    sums = rows.agg(F.count("*").alias("n"), *[
        (F.sum((F.col("p") - F.col("quality")) * F.col(n)) + F.lit(float(w))).alias(n)
        for n, w in zip(names, weights)])
    return sums.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("feature"), (F.abs(F.col(n)) < 0.002 * F.col("n")).alias("at_minimum"))
        for n in names])).alias("e")).select("e.*")


CELLS = FoldPlan(3, 3)


@check("knn_recall", "SELECT unnest(range(2)) AS replicate, TRUE AS reached")
def knn_recall(spark, sf_dir):
    """Hashed neighbours of each held-out half: at least nine in ten of the exact ones."""
    frame = stored(assign_slices(embeddings(spark, sf_dir), FoldPlan(2)), "slices")
    plan, parts = FoldPlan(2), []
    for r in range(plan.replicates):
        train, test = side(frame, plan.in_group(r)), side(frame, plan.out_group(r))
        exact, quick = (NeighborsClassifier(K, broadcast_bytes=0, recall=recall).fit(train)
                        .neighbors(test).select("t", "o") for recall in (1.0, 0.9))
        # Told by one job: each side is searched once.
        met = exact.join(quick.select("t", "o", F.lit(True).alias("met")), ["t", "o"], "left")
        told = met.agg(F.count(F.lit(1)).alias("n"), F.count("met").alias("both")).first()
        parts.append((r, told["both"] >= 0.9 * told["n"]))
    return spark.createDataFrame(parts, "replicate int, reached boolean")


@check("logreg_cells", """
    SELECT replicate, fold, feature, TRUE AS at_minimum
    FROM (SELECT unnest(range(3)) AS replicate), (SELECT unnest(range(-1, 3)) AS fold),
         (SELECT 'lang_' || lang AS feature FROM documents GROUP BY lang
          UNION ALL SELECT unnest(['n_chars', 'n_words', 'n_lines', 'n_digits', 'n_capitals',
                                   'intercept'])) f""")
def logreg_cells(spark, sf_dir):
    """Elastic net in every cross of every replicate and in each in-group (fold -1), all
    fitted together: no weight of any cell can be moved to a lower objective."""
    frame = stored(assign_slices(texts(spark, sf_dir), CELLS), "slices")
    model = LogisticClassifier("elasticnet", l1_c=0.3, l2_c=0.7)
    sides = {(r, x): CELLS.in_group(r) if x < 0 else CELLS.cross_train(r, x)
             for r in range(CELLS.replicates) for x in range(-1, CELLS.crosses)}
    fitted = LogisticClassifier.fit_cells({
        cell: (model, TrainSide(frame, tuple(slices))) for cell, slices in sides.items()})
    c, share = model.strength()
    names = [*frame.features, "intercept"]
    parts = []
    for (r, x), slices in sides.items():
        weights = fitted[r, x].weights[0].tolist()
        rows = side(frame, slices)
        scored = fitted[r, x].predict(rows).select("doc_id", F.element_at("proba", "1").alias("p"))
        sums = rows.df.withColumn("intercept", F.lit(1.0)).join(scored, "doc_id").agg(*[
            F.sum((F.col("p") - F.col("quality")) * F.col(n)).alias(n) for n in names])
        # The slope of the penalty, or its range where the weight is 0.
        parts.append(sums.select(F.lit(r).alias("replicate"), F.lit(x).alias("fold"), F.explode(F.array(*[
            F.struct(F.lit(n).alias("feature"), (_slope(F.col(n), w, c, share, n != "intercept")
                                                 < 0.001).alias("at_minimum"))
            for n, w in zip(names, weights)])).alias("e")).select("replicate", "fold", "e.*"))
    return reduce(DataFrame.unionByName, parts)


def _slope(gradient, weight: float, c: float, share: float, penalised: bool):
    """How steeply the objective falls along one weight, 0 at the minimum."""
    if not penalised:
        return F.abs(gradient)
    if weight == 0.0:
        return F.greatest(F.abs(gradient) - F.lit(share / c), F.lit(0.0))
    bend = (share * (1.0 if weight > 0 else -1.0) + (1.0 - share) * weight) / c
    return F.abs(gradient + F.lit(bend))


# One feature of two values: a single split says the most frequent class of each.
_MAJORITY = """
    WITH t AS (SELECT o_orderkey, o_orderpriority < '3' AS early, o_orderstatus FROM orders),
    m AS (SELECT early, arg_max(o_orderstatus, n) AS pred FROM (
            SELECT early, o_orderstatus, count(*) AS n FROM t GROUP BY ALL) c GROUP BY early)
    SELECT o_orderkey, pred FROM t JOIN m ON m.early = t.early"""


def _early(spark, sf_dir) -> Frame:
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "CAST(o_orderpriority < '3' AS DOUBLE) AS early")
    return Frame.of(df, "o_orderkey", "o_orderstatus")


@check("adaboost_stump", _MAJORITY)
def adaboost_stump(spark, sf_dir):
    frame = _early(spark, sf_dir)
    return BoostClassifier(1).fit(frame).predict(frame).select("o_orderkey", "pred")


_FLAGS = {"early": "o_orderpriority < '3'", "dear": "o_totalprice > 150000",
          "old": "o_orderdate < DATE '1994-06-01'"}


def _boosted_sql(rounds: int) -> str:
    """SAMME on 0/1 features over counted rows: Gini splits, votes, weights, by rounds."""
    flags = ", ".join(f"CAST({e} AS INT) AS {n}" for n, e in _FLAGS.items())
    sides = " UNION ALL ".join(f"SELECT {i} AS f, {n} AS side, label, w FROM w{{before}}"
                               for i, n in enumerate(_FLAGS))
    own = "CASE b.f " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(_FLAGS)) + " END"
    sql = f"""WITH t AS (SELECT o_orderkey, o_orderstatus AS label, {flags} FROM orders),
        w0 AS (SELECT {', '.join(_FLAGS)}, label, CAST(count(*) AS DOUBLE) AS w FROM t GROUP BY ALL)"""
    for i in range(1, rounds + 1):
        sql += f""",
        s{i} AS (SELECT f, side, label, sum(w) AS w FROM ({sides.format(before=i - 1)}) u GROUP BY ALL),
        b{i} AS (SELECT f FROM (SELECT f, side, sum(w) AS m, sum(w * w) AS q FROM s{i} GROUP BY f, side) g
                 GROUP BY f HAVING count(*) = 2 ORDER BY sum(m - q / m), f LIMIT 1),
        l{i} AS (SELECT side, label AS pick, w FROM (SELECT s.*, row_number() OVER (
                   PARTITION BY side ORDER BY w DESC, label) AS k FROM s{i} s JOIN b{i} USING (f)) p
                 WHERE k = 1),
        v{i} AS (SELECT ln((1 - e) / e) + ln(2) AS vote FROM (
                   SELECT 1 - sum(w) / (SELECT sum(w) FROM w{i - 1}) AS e FROM l{i}) x),
        w{i} AS (SELECT x.* REPLACE (x.w * CASE WHEN pick <> label THEN exp(vote) ELSE 1 END AS w)
                 FROM w{i - 1} x, b{i} b, v{i}, l{i} l WHERE l.side = {own})"""
    votes = " UNION ALL ".join(
        f"SELECT o_orderkey, pick, vote FROM t, b{i} b, v{i}, l{i} l WHERE l.side = {own}"
        for i in range(1, rounds + 1))
    return sql + f""",
        votes AS (SELECT o_orderkey, label AS pick, sum(CASE WHEN pick = label THEN vote ELSE 0 END)
                  AS v, sum(vote) AS total FROM ({votes}) a, (SELECT DISTINCT label FROM t) c
                  GROUP BY o_orderkey, label),
        e AS (SELECT *, exp((v - (total - v) / 2) / total / 2) AS e FROM votes)
        SELECT o_orderkey, pick AS class, round(e / sum(e) OVER (PARTITION BY o_orderkey), 6) AS p FROM e"""


def _flagged(spark, sf_dir) -> Frame:
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in _FLAGS.items()])
    return Frame.of(df, "o_orderkey", "o_orderstatus")


@check("adaboost_rounds", _boosted_sql(3))
def adaboost_rounds(spark, sf_dir):
    """Three rounds on three 0/1 features, three classes: later rounds see new weights."""
    frame = _flagged(spark, sf_dir)
    preds = BoostClassifier(3).fit(frame).predict(frame)
    return rounded(preds.select("o_orderkey", F.explode("proba").alias("class", "p")))


@check("forest_split", _MAJORITY)
def forest_split(spark, sf_dir):
    frame = _early(spark, sf_dir)
    model = ForestClassifier(max_depth=1, bootstrap=False)
    return model.fit(frame).predict(frame).select("o_orderkey", "pred")


@check("forest_depth", f"""
    WITH t AS (SELECT o_orderkey, o_orderstatus, {', '.join(f"{e} AS {n}" for n, e in _FLAGS.items())}
               FROM orders),
    m AS (SELECT {', '.join(_FLAGS)}, arg_max(o_orderstatus, n) AS pred FROM (
            SELECT {', '.join(_FLAGS)}, o_orderstatus, count(*) AS n FROM t GROUP BY ALL) c GROUP BY ALL)
    SELECT o_orderkey, pred FROM t JOIN m USING ({', '.join(_FLAGS)})""")
def forest_depth(spark, sf_dir):
    """Three splits deep on three 0/1 features: the most frequent class of each combination."""
    frame = _flagged(spark, sf_dir)
    model = ForestClassifier(3, max_depth=3, bootstrap=False, max_features=None)
    return model.fit(frame).predict(frame).select("o_orderkey", "pred")


@check("custom_model", _MAJORITY)
def custom_model(spark, sf_dir):
    """A user's estimator of pyspark.ml: a tree of one split."""
    from pyspark.ml.classification import DecisionTreeClassifier
    frame = _early(spark, sf_dir)
    model = EstimatorClassifier(DecisionTreeClassifier(maxDepth=1))
    return model.fit(frame).predict(frame).select("o_orderkey", "pred")


def _margin_sql(side: str) -> str:
    return f"""
    WITH t AS (SELECT o_orderkey, o_totalprice / 100000 - 2 AS price, o_custkey % 7 / 7.0 AS other
               FROM orders),
    s AS (SELECT *, {side} AS side FROM t)
    SELECT o_orderkey, CASE WHEN side > 0.25 THEN 'far' ELSE 'near' END AS pred
    FROM s WHERE abs(side - 0.25) > 0.2"""


def _with_margin(spark, sf_dir, kernel: str, side: str, **options) -> DataFrame:
    """Rows that stand clear of a border, by a machine that has learned it."""
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_totalprice / 100000 - 2 AS price", "o_custkey % 7 / 7.0D AS other")
    df = df.withColumn("side", F.expr(side)).where("abs(side - 0.25) > 0.2")
    df = df.withColumn("label", F.expr("CASE WHEN side > 0.25 THEN 'far' ELSE 'near' END")).drop("side")
    frame = stored(Frame.of(df, "o_orderkey", "label"), "margin")
    model = SupportVectorClassifier(kernel, C=100.0, max_iter=60, **options)
    return model.fit(frame).predict(frame).select("o_orderkey", "pred")


@check("svc_linear", _margin_sql("price + other"))
def svc_linear(spark, sf_dir):
    return _with_margin(spark, sf_dir, "linear", "price + other")


@check("svc_poly", _margin_sql("price * price"))
def svc_poly(spark, sf_dir):
    return _with_margin(spark, sf_dir, "poly", "price * price", degree=2, coef0=1.0)


@check("svc_rbf", _margin_sql("price * price"))
def svc_rbf(spark, sf_dir):
    return _with_margin(spark, sf_dir, "rbf", "price * price")


@check("forest_predict")
def forest_predict(spark, sf_dir):
    return _fit_and_predict(ForestClassifier(20, "entropy", max_depth=8, min_samples_split=4),
                            spark, sf_dir)


@check("adaboost_predict")
def adaboost_predict(spark, sf_dir):
    return _fit_and_predict(BoostClassifier(5, learning_rate=0.5), spark, sf_dir)


@check("svc_predict")
def svc_predict(spark, sf_dir):
    return _fit_and_predict(SupportVectorClassifier("linear", max_iter=20), spark, sf_dir)


@check("custom_model_predict")
def custom_model_predict(spark, sf_dir):
    from pyspark.ml.classification import NaiveBayes
    return _fit_and_predict(EstimatorClassifier(NaiveBayes(modelType="gaussian")), spark, sf_dir)


class PriceRule:
    """A user's model: late when dear or ordered by an old customer."""

    def predict(self, frame: Frame) -> DataFrame:
        late = (F.col("price") > 250000) | (F.col("customer") < 500)
        return frame.df.select(*frame.keys, F.when(late, "F").otherwise("O").alias("pred"))


@check("permutation_importance", """
    WITH t AS (SELECT o_orderkey AS row_id, CASE WHEN o_totalprice > 250000 THEN 'F'
                      ELSE o_orderstatus END AS label, o_totalprice AS price,
                      o_custkey AS customer, o_orderdate AS day FROM orders),
    n AS (SELECT *, md5('9|' || CAST(k AS VARCHAR) || '|' || CAST(row_id AS VARCHAR)) AS h
          FROM t, range(5) r(k)),
    s AS (SELECT k, label, price, customer,
                 coalesce(lead(price) OVER w, first_value(price) OVER w) AS price2,
                 coalesce(lead(customer) OVER w, first_value(customer) OVER w) AS customer2
          FROM n WINDOW w AS (PARTITION BY k ORDER BY h, row_id)),
    base AS (SELECT avg(CAST((CASE WHEN price > 250000 OR customer < 500 THEN 'F' ELSE 'O' END)
                        = label AS INT)) AS a FROM t)
    SELECT feature, round((SELECT a FROM base) - avg(CAST(hit AS INT)), 6) AS importance FROM (
      SELECT 'price' AS feature, (CASE WHEN price2 > 250000 OR customer < 500 THEN 'F'
             ELSE 'O' END) = label AS hit FROM s
      UNION ALL SELECT 'customer', (CASE WHEN price > 250000 OR customer2 < 500 THEN 'F'
             ELSE 'O' END) = label FROM s
      UNION ALL SELECT 'day', (CASE WHEN price > 250000 OR customer < 500 THEN 'F'
             ELSE 'O' END) = label FROM s) u GROUP BY feature""")
def importance(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS row_id", "CASE WHEN o_totalprice > 250000 THEN 'F' ELSE o_orderstatus END "
        "AS label", "o_totalprice AS price", "o_custkey AS customer", "o_orderdate AS day")
    # Small pieces: the cuts change no result.
    found = permutation_importance(PriceRule(), Frame.of(df, "row_id", "label"), seed=9,
                                   bucket_rows=100)
    return rounded(found)


@check("custom_metric_features", """
    WITH t AS (SELECT o_orderstatus AS label, o_totalprice AS price, o_orderpriority AS priority,
                      CASE WHEN o_totalprice > 250000 OR o_custkey < 500 THEN 'F' ELSE 'O' END AS pred
               FROM orders)
    SELECT priority, 'right_value' AS metric,
           round(sum(CASE WHEN label = pred THEN price ELSE 0 END) / sum(price), 6) AS value
    FROM t GROUP BY priority""")
def custom_metric_features(spark, sf_dir):
    """A metric that needs a feature: the share of the value that was predicted right."""
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "o_orderpriority AS priority", "o_totalprice AS price",
        "o_custkey AS customer")
    frame = Frame.of(df, "o_orderkey", "o_orderstatus", ["priority"])

    def right_value(rows, by):
        value = F.sum(F.when(F.col("label") == F.col("pred"), F.col("price")).otherwise(0.0))
        return rows.groupBy(*by).agg((value / F.sum("price")).alias("right_value"))

    metric = FeatureMetric(right_value, ("price",))
    preds = PriceRule().predict(frame).withColumnRenamed("o_orderstatus", "label")
    rows = with_features(preds, frame, metric.features)
    found = evaluate(rows, ["priority"], ["right_value"], {"right_value": metric})
    return rounded(found.select("priority", "metric", "value"))


# --- Parameter search --------------------------------------------------------

SPACE = {"model": {
    "rate": {"type": "float", "low": 0.001, "high": 1000.0, "log": True},
    "share": {"type": "float", "low": 0.0, "high": 1.0, "step": 0.25},
    "depth": {"type": "int", "low": 2, "high": 12, "step": 2},
    "kernel": {"type": "categorical", "choices": ["linear", "poly", None]},
    "fixed": {"type": "constant", "value": 7}}}


def _u(label: str) -> str:
    return (f"(CAST('0x' || substr(md5('5|' || CAST(replicate AS VARCHAR) || '|' || "
            f"CAST(trial AS VARCHAR) || '|{label}'), 1, 13) AS BIGINT) / 4503599627370496.0)")


_TABLE = f"""
    SELECT run, replicate, trial, round(exp(ln(0.001) + {_u('rate')} * (ln(1000.0) - ln(0.001))),
             6) AS rate, round(0.25 * floor({_u('share')} * 5), 6) AS share,
           CAST(2 + 2 * floor({_u('depth')} * 6) AS BIGINT) AS depth,
           CASE CAST(floor({_u('kernel')} * 3) AS INT) WHEN 0 THEN 'linear' WHEN 1 THEN 'poly' END
             AS kernel, '7' AS fixed FROM ({LOG_SQL}) l"""


@check("trial_table", _TABLE)
def trial_table(spark, sf_dir):
    keys = run_log(spark, sf_dir).select("run", "replicate", "trial")
    return rounded(Space.of(SPACE).sample(keys, 5))


PENALTIES = {"0_principal_component_analysis": {
                 "proportion": {"type": "float", "low": 0.1, "high": 0.9}},
             "1_recursive_feature_elimination": {
                 "proportion": {"type": "float", "low": 0.5, "high": 0.9}},
             "model": {"penalty": {"type": "categorical", "choices": ["l1", "l2", None]},
                       "l1_c": {"type": "float", "low": 0.01, "high": 50.0, "log": True},
                       "l2_c": {"type": "float", "low": 0.01, "high": 50.0, "log": True}}}


def _log_uniform(label: str) -> str:
    return f"exp(ln(0.01) + {_u(label)} * (ln(50.0) - ln(0.01)))"


@check("trial_params", f"""
    SELECT replicate, trial, round(0.1 + {_u('proportion')} * 0.8, 6) AS proportion,
           round(0.5 + {_u('1_recursive_feature_elimination.proportion')} * 0.4, 6)
             AS "1_recursive_feature_elimination.proportion", penalty,
           CASE WHEN penalty = 'l1' THEN round({_log_uniform('l1_c')}, 6) END AS l1_c,
           CASE WHEN penalty = 'l2' THEN round({_log_uniform('l2_c')}, 6) END AS l2_c
    FROM (SELECT *, CASE CAST(floor({_u('penalty')} * 3) AS INT) WHEN 0 THEN 'l1'
                    WHEN 1 THEN 'l2' END AS penalty FROM ({LOG_SQL}) l) t""")
def trial_params(spark, sf_dir):
    """What a trial records: unsampled parameters are null, equal labels apart."""
    space = Space.of(PENALTIES)
    drawn = space.sample(run_log(spark, sf_dir).select("replicate", "trial"), 5)
    used = {p: Logistic.sampled({"penalty": p, "l1_c": 0, "l2_c": 0}) for p in ("l1", "l2", None)}
    for strength in ("l1_c", "l2_c"):
        asked = [p for p, names in used.items() if strength in names]
        drawn = drawn.withColumn(strength, F.when(F.col("penalty").isin(asked), F.col(strength)))
    return rounded(drawn)


@check("propose_trials")
def propose_trials(spark, sf_dir):
    space = Space.of({"model": {k: SPACE["model"][k] for k in ("rate", "depth", "kernel")}})
    history = space.sample(run_log(spark, sf_dir).select("replicate", "trial", "objective"), 5)
    return rounded(propose(history, space, seed=11))


STUDY_PLAN = FoldPlan(2, 2)
STUDY_METRICS = {"train": ["balanced_accuracy"], "validate": ["balanced_accuracy"],
                 "test": ["balanced_accuracy", "sk_f1_weighted_avg", "correct_samples"]}


def _study_sql() -> str:
    """The whole study over: folds, drawn parameters, scaling by in-group, neighbours, scores."""
    plan = STUDY_PLAN
    cells = []
    for r in range(plan.replicates):
        cells += [(r, "train", x, plan.cross_train(r, x), plan.cross_test(r, x))
                  for x in range(plan.crosses)]
        cells += [(r, "validate", -1, plan.in_group(r), plan.in_group(r)),
                  (r, "test", -1, plan.in_group(r), plan.out_group(r))]
    listed = ", ".join(f"({r}, '{stage}', {x}, {learn}, {test})" for r, stage, x, learn, test in cells)

    def u(label: str) -> str:
        return (f"(CAST('0x' || substr(md5('{FOLD_SEED}|' || CAST(replicate AS VARCHAR) || '|' || "
                f"CAST(trial AS VARCHAR) || '|{label}'), 1, 13) AS BIGINT) / 4503599627370496.0)")

    def score(metric: str, stage: str, cross: int = -1) -> str:
        return f"round(max({metric}) FILTER (WHERE stage = '{stage}' AND fold = {cross}), 6)"

    return f"""
    WITH e AS (SELECT row_id, label, x, g % 4 AS s FROM ({positions_sql(
        "SELECT vec_id AS row_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings")}) p),
    c(r, stage, fold, learn, test) AS (VALUES {listed}),
    p AS (SELECT replicate, trial, CAST(3 + floor({u('n_neighbors')} * 7) AS BIGINT) AS n_neighbors,
                 CASE CAST(floor({u('weights')} * 2) AS INT) WHEN 0 THEN 'uniform' ELSE 'distance' END
                   AS weights
          FROM (SELECT unnest(range(2)) AS replicate) a, (SELECT unnest(range(2)) AS trial) b),
    l AS (SELECT row_id, s, unnest(x) AS v, unnest(range(len(x))) AS j FROM e),
    m AS (SELECT r, j, avg(v) AS mean, stddev_pop(v) AS sd FROM l, (SELECT unnest(range(2)) AS r) q
          WHERE s % 2 <> r GROUP BY r, j),
    z AS (SELECT r, row_id, list((v - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END ORDER BY j) AS x
          FROM l JOIN m USING (j) GROUP BY r, row_id),
    d AS (SELECT a.r, a.row_id AS t, b.row_id AS o, list_distance(a.x, b.x) AS d
          FROM z a JOIN z b ON a.r = b.r),
    n AS (SELECT c.r, stage, fold, t, ea.label, eb.label AS voted, d,
                 row_number() OVER (PARTITION BY c.r, stage, fold, t ORDER BY round(d, 9), o) AS n
          FROM c JOIN d ON d.r = c.r JOIN e ea ON ea.row_id = t JOIN e eb ON eb.row_id = o
          WHERE list_contains(test, ea.s) AND list_contains(learn, eb.s)),
    k AS (SELECT *, bool_or(d = 0) OVER (PARTITION BY r, trial, stage, fold, t) AS same
          FROM n JOIN p ON p.replicate = n.r AND n <= n_neighbors),
    v AS (SELECT replicate, trial, stage, fold, t, label, voted, sum(
                 CASE WHEN weights = 'uniform' THEN 1 WHEN NOT same THEN 1 / d
                      WHEN d = 0 THEN 1 ELSE 0 END) AS votes FROM k GROUP BY ALL),
    w AS (SELECT replicate, trial, stage, fold, t, label, voted AS pred FROM (
            SELECT *, row_number() OVER (PARTITION BY replicate, trial, stage, fold, t
                                         ORDER BY votes DESC, voted) AS place FROM v) q WHERE place = 1),
    f AS (SELECT replicate, trial, stage, fold, class,
                 count(*) FILTER (WHERE label = class) AS own,
                 count(*) FILTER (WHERE pred = class) AS told,
                 count(*) FILTER (WHERE label = class AND pred = class) AS hit
          FROM w, (SELECT DISTINCT label AS class FROM e) q GROUP BY ALL),
    g AS (SELECT replicate, trial, stage, fold, avg(hit / own) FILTER (WHERE own > 0) AS balanced,
                 sum(own * CASE WHEN own + told > 0 THEN 2 * hit / (own + told) ELSE 0 END) / sum(own)
                   AS f1, sum(hit) AS correct FROM f GROUP BY ALL)
    SELECT CAST(replicate AS INT) AS replicate, CAST(trial AS INT) AS trial,
           round(avg(balanced) FILTER (WHERE stage = 'train'), 6) AS objective,
           any_value(n_neighbors) AS n_neighbors, any_value(weights) AS weights,
           {score('balanced', 'train', 0)} AS "balanced_accuracy (train) [0]",
           {score('balanced', 'train', 1)} AS "balanced_accuracy (train) [1]",
           {score('balanced', 'validate')} AS "balanced_accuracy (validate)",
           {score('balanced', 'test')} AS "balanced_accuracy (test)",
           {score('f1', 'test')} AS "sk_f1_weighted_avg (test)",
           CAST(max(correct) FILTER (WHERE stage = 'test') AS BIGINT) AS "correct_samples (test)"
    FROM g JOIN p USING (replicate, trial) GROUP BY replicate, trial"""


@check("study_small", _study_sql())
def study_small(spark, sf_dir):
    """Two replicates, two crosses, two trials of tuned nearest neighbours."""
    study = Study(
        {"label": "embeddings", "post_split_hooks": [{"type": "standard_scaling"}]},
        {"label": "knn", "model": "KNNC", "parameters": {
            "n_neighbors": {"type": "int", "low": 3, "high": 9},
            "weights": {"type": "categorical", "choices": ["uniform", "distance"]}}},
        {"label": "small", "target": "label", "objective": "balanced_accuracy",
         "no_replicates": STUDY_PLAN.replicates, "no_crosses": STUDY_PLAN.crosses, "no_trials": 2,
         "metrics": STUDY_METRICS})
    frame = embeddings(spark, sf_dir)
    # The target starts as a feature and is isolated by the study.
    open_frame = Frame.of(frame.df, "row_id")
    store = ResultStore(spark, scratch_dir(spark, "results"))
    return rounded(study.run(spark, store, open_frame))
