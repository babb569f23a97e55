"""Questions about stored results."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.frame import col
from foldwise.functions.ordered import running_totals


def metric_across_trials(results: DataFrame, metric: str) -> DataFrame:
    return results.select(col(metric))


def best_trials(results: DataFrame, metric: str, maximize: bool = True,
                replicate: str = "replicate", trial: str = "trial",
                objective: str = "objective", minimize_objective: bool = True) -> DataFrame:
    """The best trial of each replicate: by metric, then objective, then trial.

    Unknown metrics never win. The rank filter keeps one row per replicate and
    task before the shuffle, however many trials a replicate has.
    """
    first = col(metric).desc_nulls_last() if maximize else col(metric).asc_nulls_last()
    second = (col(objective).asc_nulls_last() if minimize_objective
              else col(objective).desc_nulls_last())
    order = Window.partitionBy(col(replicate)).orderBy(first, second, col(trial))
    return (results.withColumn("__n", F.row_number().over(order))
            .filter(F.col("__n") == 1).drop("__n"))


def expected_performance(best: DataFrame, metric: str) -> DataFrame:
    """Mean and sample deviation over replicates."""
    return best.agg(F.avg(col(metric)).alias("mean"), F.stddev_samp(col(metric)).alias("std"))


def by_trial(results: DataFrame, metrics: dict[str, str], trial: str = "trial") -> DataFrame:
    """Mean and sample deviation per trial of each metric; ``metrics`` maps a
    column to the prefix of its two outputs."""
    return results.groupBy(col(trial).alias("trial")).agg(*[
        f(col(m)).alias(f"{p}_{tag}") for m, p in metrics.items()
        for tag, f in (("mean", F.avg), ("std", F.stddev_samp))])


def overfit_gap(results: DataFrame, validate: str, test: str, trial: str = "trial") -> DataFrame:
    """Both stages side by side per trial, and how far test falls behind."""
    both = by_trial(results, {validate: "validate", test: "test"}, trial)
    return both.withColumn("gap", F.col("validate_mean") - F.col("test_mean"))


def compare_runs(log: DataFrame, metric: str, runs: list[str], run: str = "run",
                 trial: str = "trial") -> DataFrame:
    """Mean and deviation per trial, one pair of columns per run."""
    return (log.filter(col(run).isin(runs)).groupBy(col(trial).alias("trial"))
            .pivot(run, runs)
            .agg(F.avg(col(metric)).alias("mean"), F.stddev_samp(col(metric)).alias("std")))


def rank_sum(samples: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """Rank-sum statistic of two groups: n1, n2, rank sum of the first, z.

    Average ranks for ties, normal approximation, no tie correction. Values are
    counted first; ranks are running totals over the distinct values.
    """
    counted = (samples.filter(col(group).isin(first, second) & col(value).isNotNull())
               .groupBy(col(value).alias("v"))
               .agg(F.count_if(col(group) == first).alias("a"),
                    F.count(F.lit(1)).alias("n")))
    ranked = running_totals(counted, [], "v", {"n": "below"})
    rank = F.col("below") + (F.col("n") + 1) / 2
    sums = ranked.agg(F.sum("a").alias("n1"), (F.sum("n") - F.sum("a")).alias("n2"),
                      F.sum(F.col("a") * rank).alias("rank_sum"))
    n1, n2 = F.col("n1"), F.col("n2")
    expected = n1 * (n1 + n2 + 1) / 2
    spread = F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return sums.withColumn("z", (F.col("rank_sum") - expected) / spread)


def two_sided_p(z: Column) -> Column:
    """Two-sided p value of a standard normal statistic."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")

    return tail(z)
