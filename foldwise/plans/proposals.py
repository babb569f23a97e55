"""Propose the next trial of every replicate from its history.

Tree-structured Parzen estimation (Bergstra et al., 2011), one replicate a
study of its own: the best trials and the others each give a density per
parameter, candidates are drawn from the density of the best, and the candidate
with the largest density ratio wins. Each density at the few candidates is a
sum over trials, so all replicates are scored by one grouped aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.frame import col
from foldwise.functions.hashing import uniform
from foldwise.plans.space import Parameter, Space, text
from foldwise.session import scratch_dir

# Fixed values of the published method and its usual settings.
CANDIDATES = 24
BEST_SHARE = 0.1
MOST_BEST = 25


def split_history(history: DataFrame, direction: str = "minimize",
                  replicate: str = "replicate", trial: str = "trial") -> DataFrame:
    """Mark the best tenth of each replicate's trials (at least 1, at most 25)."""
    if direction not in ("minimize", "maximize"):
        raise ValueError("direction must be minimize or maximize")
    sign = 1.0 if direction == "minimize" else -1.0
    scored = history.filter(col("objective").isNotNull()).withColumn(
        "__o", F.lit(sign) * col("objective"))
    sizes = scored.groupBy(col(replicate)).agg(
        F.least(F.ceil(F.count(F.lit(1)) * BEST_SHARE), F.lit(MOST_BEST)).alias("__best"))
    order = Window.partitionBy(col(replicate)).orderBy("__o", col(trial))
    # The rank filter lets every task keep its best few before the shuffle.
    top = (scored.select(col(replicate), col(trial), "__o")
           .withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= MOST_BEST))
    cut = (top.join(sizes, replicate).filter(F.col("__n") == F.col("__best"))
           .select(col(replicate), F.struct("__o", col(trial)).alias("__cut")))
    joined = scored.join(cut, replicate)
    return (joined.withColumn("good", F.struct("__o", col(trial)) <= F.col("__cut"))
            .drop("__o", "__cut"))


def propose(history: DataFrame, space: Space, seed: int, direction: str = "minimize",
            replicate: str = "replicate", trial: str = "trial") -> DataFrame:
    """One row per replicate with a value for every parameter."""
    path = scratch_dir(history.sparkSession, "history")
    # Read by every parameter: marked and written once.
    split_history(history, direction, replicate, trial).write.parquet(path)
    marked = history.sparkSession.read.parquet(path)
    out = None
    for p in space.parameters.values():
        pick = _categorical if p.kind == "categorical" else _numeric
        chosen = pick(marked, p, seed, replicate)
        out = chosen if out is None else out.join(chosen, replicate)
    return out


def _tries(draw) -> Column:
    """Array of CANDIDATES values; ``draw`` maps a candidate's number to one."""
    return F.transform(F.sequence(F.lit(0), F.lit(CANDIDATES - 1)), draw)


def _categorical(marked: DataFrame, p: Parameter, seed: int, replicate: str) -> DataFrame:
    """Smoothed shares; of the choices drawn, the one with the best ratio."""
    value = col(p.label)
    k = len(p.choices)
    hits = []
    for i, c in enumerate(p.choices):
        same = value.eqNullSafe(F.lit(text(c)).cast("string"))
        hits += [F.count_if(same & F.col("good")).alias(f"g{i}"),
                 F.count_if(same & ~F.col("good")).alias(f"b{i}")]
    counts = marked.groupBy(col(replicate)).agg(
        *hits, F.count_if(F.col("good")).alias("ng"), F.count_if(~F.col("good")).alias("nb"))
    shares = [(F.col(f"g{i}") + 1) / (F.col("ng") + k) for i in range(k)]
    ratios = [F.log(shares[i] * (F.col("nb") + k) / (F.col(f"b{i}") + 1)) for i in range(k)]
    upto = F.array(*[sum(shares[1:i + 1], shares[0]) for i in range(k - 1)]).cast("array<double>")

    def draw(j: Column) -> Column:
        u = uniform(seed, col(replicate), F.lit(p.label), j)
        return F.size(F.filter(upto, lambda edge: edge <= u))

    options = F.array(*[F.struct(r.alias("r"), F.lit(-i).alias("i"),
                                 F.lit(text(c)).cast("string").alias("v"))
                        for i, (c, r) in enumerate(zip(p.choices, ratios))])
    best = F.array_max(F.filter("options", lambda o: F.array_contains(F.col("drawn"), -o["i"])))
    return (counts.select(col(replicate), options.alias("options"), _tries(draw).alias("drawn"))
            .select(col(replicate), best["v"].alias(p.label)))


def _numeric(marked: DataFrame, p: Parameter, seed: int, replicate: str) -> DataFrame:
    """Gaussian kernels of Scott's width, in log space for log parameters."""
    inner = F.log if p.log else (lambda c: c)
    outer = F.exp if p.log else (lambda c: c)
    low, high = [math.log(x) if p.log else float(x) for x in (p.low, p.high)]
    span = high - low or 1.0
    rows = marked.select(col(replicate).alias("__r"), "good",
                         inner(col(p.label).cast("double")).alias("__x"))

    sides = {"g": F.col("good"), "b": ~F.col("good")}
    own = {tag: F.when(is_in, F.col("__x")) for tag, is_in in sides.items()}
    stats = rows.groupBy("__r").agg(
        *[f(own[tag]).alias(f"{name}{tag}") for tag in sides
          for name, f in (("n", F.count), ("s", F.stddev_pop))],
        # At most 25 rows of a replicate are good, so their list is short.
        F.sort_array(F.collect_list(own["g"])).alias("centres"))
    for tag in sides:
        scott = F.coalesce(F.col(f"s{tag}"), F.lit(0.0)) * F.pow(
            F.greatest(F.col(f"n{tag}"), F.lit(1)).cast("double"), F.lit(-0.2))
        stats = stats.withColumn(f"h{tag}", F.greatest(scott, F.lit(span / 100)))

    def draw(j: Column) -> Column:
        u = {name: uniform(seed, F.col("__r"), F.lit(p.label), j, F.lit(name)) for name in "curn"}
        # Any of the good trials, or a uniform draw that stands for the prior.
        place = F.floor(u["c"] * (F.size("centres") + 1)).cast("int")
        noise = F.sqrt(-2 * F.log(1 - u["r"])) * F.cos(2 * math.pi * u["n"])
        near = F.try_element_at(F.col("centres"), place + 1) + noise * F.col("hg")
        point = F.coalesce(near, low + u["u"] * span)
        point = F.least(F.greatest(point, F.lit(low)), F.lit(high))
        return inner(p.settle(outer(point)).cast("double"))

    candidates = stats.select("__r", "hg", "hb", "ng", "nb", _tries(draw).alias("cs"))
    # A row adds its kernel to each of the few candidates of its replicate.
    parts = (rows.filter(F.col("__x").isNotNull()).join(candidates, "__r")
             .select("__r", "good", "__x", "hg", "hb", F.posexplode("cs").alias("j", "c")))
    density = parts.groupBy("__r", "j", "c").agg(*[
        F.sum(F.when(is_in, F.exp(-F.pow((F.col("c") - F.col("__x")) / F.col(f"h{tag}"), 2) / 2)
                     / F.col(f"h{tag}"))).alias(tag) for tag, is_in in sides.items()])
    flat = math.sqrt(2.0 * math.pi) / span

    def mixed(tag: str) -> Column:
        return (F.coalesce(F.col(tag), F.lit(0.0)) + flat) / (F.col(f"n{tag}") + 1)

    scored = (candidates.select("__r", "ng", "nb", F.posexplode("cs").alias("j", "c"))
              .join(density.select("__r", "j", "g", "b"), ["__r", "j"], "left"))
    best = F.max(F.struct((F.log(mixed("g")) - F.log(mixed("b"))).alias("r"),
                          (-F.col("j")).alias("j"), F.col("c").alias("c")))
    return (scored.groupBy("__r").agg(best.alias("best"))
            .select(F.col("__r").alias(replicate),
                    p.settle(outer(F.col("best.c"))).alias(p.label)))
