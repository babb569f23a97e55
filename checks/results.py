"""Queries on a log of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import LOG_SQL, check, rounded, run_log, table
from foldwise.plans import report as R
from foldwise.sources.results import repair_types, run_of, runs_of

COLUMNS = "replicate, trial, step, objective, score, held_out"


@check("run_list", "SELECT DISTINCT event_type AS run FROM events")
def run_list(spark, sf_dir):
    return runs_of(run_log(spark, sf_dir))


@check("run_load", f"SELECT {COLUMNS} FROM ({LOG_SQL}) l WHERE run = 'click'")
def run_load(spark, sf_dir):
    return run_of(run_log(spark, sf_dir), "click")


@check("metric_column", f"SELECT held_out FROM ({LOG_SQL}) l")
def metric_column(spark, sf_dir):
    return R.metric_across_trials(run_log(spark, sf_dir), "held_out")


_BEST = f"""
    WITH b AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY {{keys}}replicate
               ORDER BY score DESC, objective, trial) AS n FROM ({LOG_SQL}) l) x WHERE n = 1)"""


@check("best_trial", _BEST.format(keys="") + f" SELECT run, {COLUMNS} FROM b")
def best_trial(spark, sf_dir):
    return R.best_trials(run_log(spark, sf_dir), "score")


@check("expected_performance", _BEST.format(keys="") + """
    SELECT round(avg(held_out), 6) AS mean, round(stddev_samp(held_out), 6) AS std FROM b""")
def expected_performance(spark, sf_dir):
    best = R.best_trials(run_log(spark, sf_dir), "score")
    return rounded(R.expected_performance(best, "held_out"))


@check("by_trial", f"""
    SELECT step AS trial, round(avg(objective), 6) AS objective_mean,
           round(stddev_samp(objective), 6) AS objective_std FROM ({LOG_SQL}) l GROUP BY step""")
def by_trial(spark, sf_dir):
    return rounded(R.by_trial(run_log(spark, sf_dir), {"objective": "objective"}, "step"))


@check("overfit_gap", f"""
    SELECT step AS trial, round(avg(score), 6) AS validate_mean,
           round(stddev_samp(score), 6) AS validate_std, round(avg(held_out), 6) AS test_mean,
           round(stddev_samp(held_out), 6) AS test_std,
           round(avg(score) - avg(held_out), 6) AS gap FROM ({LOG_SQL}) l GROUP BY step""")
def overfit_gap(spark, sf_dir):
    return rounded(R.overfit_gap(run_log(spark, sf_dir), "score", "held_out", "step"))


def _pair(run: str) -> str:
    own = f"CASE WHEN run = '{run}' THEN held_out END"
    return (f"round(avg({own}), 6) AS {run}_mean, round(stddev_samp({own}), 6) AS {run}_std")


@check("compare_runs", f"""
    SELECT step AS trial, {_pair('click')}, {_pair('view')} FROM ({LOG_SQL}) l
    WHERE run IN ('click', 'view') GROUP BY step""")
def compare_runs(spark, sf_dir):
    return rounded(R.compare_runs(run_log(spark, sf_dir), "held_out", ["click", "view"],
                                  trial="step"))


_RANKSUM = f"""
    WITH s AS (SELECT run, held_out AS v FROM ({LOG_SQL}) l WHERE run IN ('click', 'view')),
    r AS (SELECT run, rank() OVER (ORDER BY v)
                 + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS place FROM s),
    t AS (SELECT count(*) FILTER (run = 'click') AS n1, count(*) FILTER (run = 'view') AS n2,
                 sum(CASE WHEN run = 'click' THEN place ELSE 0 END) AS rank_sum FROM r)
    SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(rank_sum, 6) AS rank_sum,
           round((rank_sum - n1 * (n1 + n2 + 1) / 2.0)
                 / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 6) AS z FROM t"""


@check("ranksum_z", _RANKSUM)
def ranksum_z(spark, sf_dir):
    return rounded(R.rank_sum(run_log(spark, sf_dir), "run", "held_out", "click", "view"))


# Whole numbers that a double can't tell apart.
_LARGE = "9007199254740993 + event_id % 5000"


@check("ranksum_bucketed", _RANKSUM.replace(
    f"SELECT run, held_out AS v FROM ({LOG_SQL}) l WHERE run IN",
    f"SELECT event_type AS run, {_LARGE} AS v FROM events WHERE event_type IN"))
def ranksum_bucketed(spark, sf_dir):
    """Values are ordered as they are, not as doubles."""
    df = table(spark, sf_dir, "events").selectExpr("event_type AS run", f"{_LARGE} AS v")
    return rounded(R.rank_sum(df, "run", "v", "click", "view"))


# The normal tail by a series of Horner steps (Abramowitz and Stegun 26.2.17,
# error below 7.5e-8), rounded to 6 digits on both sides.
_TAIL = """2 * exp(-z * z / 2.0) / sqrt(2 * pi()) * (k * (0.319381530 + k * (-0.356563782
           + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))))"""


@check("ranksum_p", _RANKSUM.replace("SELECT CAST(n1", ", w AS (SELECT CAST(n1", 1)
       .replace(" FROM t)\n    , w", " FROM t), w") + f"""), u AS (
       SELECT abs(z) AS z, 1 / (1 + 0.2316419 * abs(z)) AS k FROM w)
    SELECT round(z, 4) AS z, round({_TAIL}, 4) AS p FROM u""")
def ranksum_p(spark, sf_dir):
    found = R.rank_sum(run_log(spark, sf_dir), "run", "held_out", "click", "view")
    z = F.abs(F.round("z", 6))
    return rounded(found.select(z.alias("z"), R.two_sided_p(z).alias("p")), 4)


@check("metric_cast", """
    SELECT event_id, round(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 6) AS metric
    FROM events""")
def metric_cast(spark, sf_dir):
    """An interrupted write left text where numbers belong."""
    damaged = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_type = 'error' THEN 'NULL' ELSE CAST(value AS STRING) END "
        "AS metric")
    return rounded(repair_types(damaged, {"metric": "double"}))
