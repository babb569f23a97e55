"""Queries on metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, rounded, table, view
from foldwise.functions.hashing import uniform
from foldwise.functions.vectors import class_map
from foldwise.operators import metrics as M

# A scored binary prediction for each order, per priority. Few distinct scores,
# so that ties matter.
_SCORED = """
    WITH p AS (SELECT o_orderpriority AS cell, o_orderkey AS row_id,
                      CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
                      round(CAST('0x' || substr(md5('3|' || CAST(o_orderkey AS VARCHAR)), 1, 13)
                            AS BIGINT) / 4503599627370496.0, 3) AS s FROM orders)"""


def scored(spark, sf_dir):
    s = F.round(uniform(3, F.col("o_orderkey")), 3)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("cell"), F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        (s > 0.5).cast("int").alias("pred"),
        F.create_map(F.lit("0"), 1.0 - s, F.lit("1"), s).alias("proba"))


@check("log_loss", _SCORED + """
    SELECT cell, round(avg(-ln(least(greatest(CASE WHEN label = 1 THEN s ELSE 1.0 - s END,
           2.220446049250313e-16), 1.0 - 2.220446049250313e-16))), 6) AS log_loss
    FROM p GROUP BY cell""")
def log_loss(spark, sf_dir):
    return rounded(M.log_loss(scored(spark, sf_dir), ["cell"]))


_AUC = _SCORED + """,
    r AS (SELECT cell, label, rank() OVER (PARTITION BY cell ORDER BY s)
                 + (count(*) OVER (PARTITION BY cell, s) - 1) / 2.0 AS place FROM p)
    SELECT cell, round((sum(CASE WHEN label = 1 THEN place ELSE 0 END)
             - sum(label) * (sum(label) + 1) / 2.0)
             / (sum(label) * (count(*) - sum(label))), 6) AS roc_auc FROM r GROUP BY cell"""


@check("roc_auc", _AUC)
def roc_auc(spark, sf_dir):
    return rounded(M.roc_auc(scored(spark, sf_dir), ["cell"]))


# Scores below 0.1 are missing; missing scores rank lowest, as ties.
_AUC_NULLS = _AUC.replace(" FROM p)", " FROM (SELECT cell, label, CASE WHEN s < 0.1 THEN -1 ELSE s "
                          "END AS s FROM p) q)")


@check("roc_auc_bucketed", _AUC_NULLS)
def roc_auc_bucketed(spark, sf_dir):
    """Rows without a score count, below all others."""
    s = F.col("proba")["1"]
    return rounded(M.roc_auc(scored(spark, sf_dir), ["cell"], F.when(s >= 0.1, s),
                             F.col("label") == 1))


def scored_as(spark, sf_dir, kind: str, classes: list):
    """Labels of another type, probabilities named as a model names them."""
    df = scored(spark, sf_dir)
    proba = class_map(F.array(F.col("proba")["0"], F.col("proba")["1"]), classes)
    return df.withColumns({"label": F.col("label").cast(kind), "pred": F.col("pred").cast(kind),
                           "proba": proba})


@check("log_loss_boolean", _SCORED + """
    SELECT cell, round(avg(-ln(least(greatest(CASE WHEN label = 1 THEN s ELSE 1.0 - s END,
           2.220446049250313e-16), 1.0 - 2.220446049250313e-16))), 6) AS log_loss
    FROM p GROUP BY cell""")
def log_loss_boolean(spark, sf_dir):
    return rounded(M.log_loss(scored_as(spark, sf_dir, "boolean", [False, True]), ["cell"]))


@check("roc_auc_boolean", _AUC)
def roc_auc_boolean(spark, sf_dir):
    return rounded(M.roc_auc(scored_as(spark, sf_dir, "boolean", [False, True]), ["cell"]))


@check("roc_auc_double", _AUC)
def roc_auc_double(spark, sf_dir):
    return rounded(M.roc_auc(scored_as(spark, sf_dir, "double", [0.0, 1.0]), ["cell"]))


def _recall_of(kind: str) -> str:
    return _SCORED + f"""
    SELECT cell, CAST(label AS {kind}) AS class,
           round(avg(CASE WHEN (s > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS recall
    FROM p GROUP BY cell, label"""


@check("recall_boolean", _recall_of("BOOLEAN"))
def recall_boolean(spark, sf_dir):
    return rounded(M.per_class(scored_as(spark, sf_dir, "boolean", [False, True]), "recall",
                               ["cell"]))


@check("recall_double", _recall_of("DOUBLE"))
def recall_double(spark, sf_dir):
    return rounded(M.per_class(scored_as(spark, sf_dir, "double", [0.0, 1.0]), "recall",
                               ["cell"]))


# Quality as truth, absence of toxicity as prediction, per language.
RATED = {"row_id": "doc_id", "label": "quality", "pred": "1 - toxic"}
_RATED = """
    WITH p AS (SELECT d.lang AS cell, l.doc_id AS row_id, l.quality AS label, 1 - l.toxic AS pred
               FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def rated(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").selectExpr("doc_id AS row_id", "lang AS cell")
    return view(spark, sf_dir, "labels", RATED).join(langs, "row_id")


# A return flag guessed from a line's status and quantity, per line number.
LINES = {"cell": "l_linenumber", "label": "l_returnflag",
         "pred": "CASE WHEN l_linestatus = 'F' THEN 'A' WHEN l_quantity > 25 THEN 'N' ELSE 'X' END"}
_LINES = f"""
    WITH p AS (SELECT {', '.join(f'{e} AS {n}' for n, e in LINES.items())} FROM lineitem)"""


def lines(spark, sf_dir):
    return view(spark, sf_dir, "lineitem", LINES)


_CLASSES = """,
    k AS (SELECT DISTINCT cell, label AS class FROM p UNION SELECT DISTINCT cell, pred FROM p),
    c AS (SELECT k.cell, k.class, count(*) FILTER (label = pred AND label = class) AS tp,
                 count(*) FILTER (label = class) AS nt, count(*) FILTER (pred = class) AS np
          FROM k JOIN p ON p.cell = k.cell GROUP BY k.cell, k.class),
    s AS (SELECT cell, class, nt, CASE WHEN np > 0 THEN tp / CAST(np AS DOUBLE) ELSE 0 END
                 AS "precision", CASE WHEN nt > 0 THEN tp / CAST(nt AS DOUBLE) ELSE 0 END AS recall,
                 CASE WHEN nt + np > 0 THEN 2 * tp / CAST(nt + np AS DOUBLE) ELSE 0 END AS f1
          FROM c)"""


@check("balanced_accuracy", _LINES + _CLASSES + """
    SELECT cell, round(avg(recall), 6) AS balanced_accuracy FROM s WHERE nt > 0 GROUP BY cell""")
def balanced_accuracy(spark, sf_dir):
    return rounded(M.balanced_accuracy(lines(spark, sf_dir), ["cell"]))


def _weighted(kind: str) -> str:
    return _RATED + _CLASSES + (
        f"SELECT cell, round(sum(\"{kind}\" * nt) / sum(nt), 6) AS \"{kind}\" "
        "FROM s GROUP BY cell")


def _perclass(kind: str) -> str:
    return _LINES + _CLASSES + f"SELECT cell, class, round(\"{kind}\", 6) AS \"{kind}\" FROM s"


for _kind in ("precision", "recall", "f1"):
    check(f"{_kind}_weighted", _weighted(_kind))(
        lambda spark, sf_dir, kind=_kind: rounded(
            M.weighted_average(rated(spark, sf_dir), kind, ["cell"])))
    check(f"{_kind}_perclass", _perclass(_kind))(
        lambda spark, sf_dir, kind=_kind: rounded(
            M.per_class(lines(spark, sf_dir), kind, ["cell"])))


@check("perclass_map", _LINES + _CLASSES + """
    SELECT cell, count(*) AS classes, round(sum(f1), 6) AS f1 FROM s GROUP BY cell""")
def perclass_map(spark, sf_dir):
    found = M.per_class_map(lines(spark, sf_dir), "f1", ["cell"])
    total = F.aggregate(F.map_values("f1"), F.lit(0.0), lambda a, b: a + b)
    return rounded(found.select("cell", F.size("f1").cast("bigint").alias("classes"),
                                total.alias("f1")))


@check("correct_rows", _RATED + "SELECT cell, row_id, label, pred FROM p WHERE label = pred")
def correct_rows(spark, sf_dir):
    return M.correct_rows(rated(spark, sf_dir)).select("cell", "row_id", "label", "pred")


@check("incorrect_rows", _RATED + "SELECT cell, row_id, label, pred FROM p WHERE label <> pred")
def incorrect_rows(spark, sf_dir):
    return M.incorrect_rows(rated(spark, sf_dir)).select("cell", "row_id", "label", "pred")


@check("custom_metric", _RATED + """
    SELECT cell, 'miss_rate' AS metric, round(avg(CAST(label <> pred AS INT)), 6) AS value FROM p
    GROUP BY cell""")
def custom_metric(spark, sf_dir):
    def miss_rate(preds, by):
        wrong = (F.col("label") != F.col("pred")).cast("int")
        return preds.groupBy(*by).agg(F.avg(wrong).alias("miss_rate"))

    found = M.evaluate(rated(spark, sf_dir), ["cell"], ["miss_rate"], {"miss_rate": miss_rate})
    return rounded(found.select("cell", "metric", "value"))
