"""Reward analytics: combined rewards, group-relative advantages, their metrics, filters and shaping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .scans import ROWS_PER_PART, running, same

EPS = 1e-4


def combined(rewards: list[str], weights: list[float], kl: str | None = None, beta: float = 0.0) -> Column:
    """Weighted sum of reward columns, a missing reward (null) counting nothing; less beta * KL if given."""
    total = F.lit(0.0)
    for c, w in zip(rewards, weights, strict=True):
        total = total + F.coalesce(F.col(c).cast("double") * w, F.lit(0.0))
    return total - beta * F.coalesce(F.col(kl), F.lit(0.0)) if kl else total


def _over_all(df: DataFrame, aggs: list[Column]) -> DataFrame:
    """df with aggregates over all rows, by way of a one-row table instead of a single-task window."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def advantages(df: DataFrame, group: str, reward: str, estimator: str = "grpo", scale: str = "group") -> DataFrame:
    """df with `advantage` (E3). `grpo`: reward - group mean; `rloo`: K/(K-1) of it; `reinforce_plus_plus`: scaled by the
    deviation of the advantages. Scale: the group's or all rows' sample deviation + 1e-4 (a single row's is 0), or none."""
    g = df.groupBy(group).agg(F.avg(reward).alias("_m"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_s"), F.count("*").alias("_k"))
    own = df.join(g, group)
    base = F.col(reward) - F.col("_m")
    if estimator == "rloo":
        base = F.when(F.col("_k") > 1, base * F.col("_k") / (F.col("_k") - 1)).otherwise(base)
    own = own.withColumn("_a", base)
    if scale == "none":
        return own.withColumn("advantage", F.col("_a")).drop("_m", "_s", "_k", "_a")
    if estimator == "reinforce_plus_plus":
        if scale == "group":
            s = own.groupBy(group).agg(F.coalesce(F.stddev_samp("_a"), F.lit(0.0)).alias("_d"))
            own = own.join(s, group)
        else:
            own = _over_all(own, [F.coalesce(F.stddev_samp("_a"), F.lit(0.0)).alias("_d")])
    elif scale == "group":
        own = own.withColumn("_d", F.col("_s"))
    else:
        own = _over_all(own, [F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_d")])
    return own.withColumn("advantage", F.col("_a") / (F.col("_d") + EPS)).drop("_m", "_s", "_k", "_a", "_d")


def gdpo(df: DataFrame, group: str, rewards: list[str], weights: list[float]) -> DataFrame:
    """df with `advantage`: each reward's z-score in its group (missing ones left out), weighted, then a z-score over all rows."""
    aggs = [x for i, c in enumerate(rewards) for x in (F.avg(c).alias(f"_m{i}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"_s{i}"))]
    own = df.join(df.groupBy(group).agg(*aggs), group)
    total = F.lit(0.0)
    for i, (c, w) in enumerate(zip(rewards, weights, strict=True)):
        total = total + F.coalesce((F.col(c) - F.col(f"_m{i}")) / (F.col(f"_s{i}") + 1e-8) * w, F.lit(0.0))
    own = _over_all(own.withColumn("_t", total), [F.avg("_t").alias("_mt"), F.coalesce(F.stddev_samp("_t"), F.lit(0.0)).alias("_st")])
    return own.withColumn("advantage", (F.col("_t") - F.col("_mt")) / (F.col("_st") + 1e-8)).select(*df.columns, "advantage")


def dynamic_advantages(df: DataFrame, request: str, order: str, group: str, reward: str) -> DataFrame:
    """Statistics over the last row of each request; every row of a request gets its advantage."""
    last = df.groupBy(request).agg(F.max_by(F.col(group), order).alias("_g"), F.max_by(F.col(reward), order).alias("_r"))
    adv = advantages(last, "_g", "_r").select(request, "advantage")
    return df.join(adv, request)


def reward_metrics(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Mean of group means, and the share of groups without deviation (2.11)."""
    g = df.groupBy(group).agg(F.avg(reward).alias("m"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("s"))
    return g.agg(F.avg("m").alias("reward"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("reward_std"), F.avg((F.abs("s") <= 1e-8).cast("double")).alias("frac_zero_std"), F.count("*").alias("n_groups"))


def varied_groups(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Rows of groups whose rewards differ."""
    ok = df.groupBy(group).agg(F.min(reward).alias("_a"), F.max(reward).alias("_b")).filter("_b > _a").select(group)
    return df.join(ok, group, "left_semi")


def cosine_length(length: Column, correct: Column, top: int, right: tuple[float, float] = (1.0, 0.5), wrong: tuple[float, float] = (-0.5, 0.0)) -> Column:
    """A reward that moves along a half cosine with length (I9): (at length 0, at the top length) for right and wrong answers."""
    cos = lambda lo, hi: F.lit(hi) - (hi - lo) * (1 - F.cos(length * math.pi / top)) / 2
    return F.when(correct, cos(right[1], right[0])).otherwise(cos(wrong[1], wrong[0]))


def soft_overlong(length: Column, most: int, cache: int) -> Column:
    """0 up to most - cache, then falling to -1 at most."""
    return F.least(-(length - (most - cache)) / cache, F.lit(0.0))


def kl3(new: Column, old: Column) -> Column:
    """Mean of exp(d) - d - 1 over tokens with d = old - new log-probability."""
    d = F.zip_with(new, old, lambda a, b: b - a)
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + F.exp(x) - x - 1) / F.nullif(F.size(d), F.lit(0))


def best_and_final(df: DataFrame, task: str, stage: str, score: str) -> DataFrame:
    """Per task: best over stages from its own on, the last stage's, and the diagonal."""
    return df.filter(F.col(stage) >= F.col(task)).groupBy(task).agg(F.max(score).alias("best"), F.max_by(score, stage).alias("final"), F.max(F.when(F.col(stage) == F.col(task), F.col(score))).alias("diagonal"))


#: Groups whose quantiles are broadcast.
FEW_GROUPS = 10_000


def entropy_mask(df: DataFrame, group: list[str], entropy: str, top: float, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """df with `kept`: tokens whose entropy reaches the group's (1 - top) quantile.

    The quantile, linear between two places, is read from running counts of the distinct values, dealt out in ranges: no task
    holds a group's values.
    """
    v = F.col(entropy)
    counts = df.groupBy(*group, entropy).agg(F.count(v).alias("_n"))
    sums = running(counts, group, [entropy], {"_hi": F.col("_n")}, rows_per_part)
    sizes = counts.groupBy(*group).agg(((F.sum("_n") - 1) * F.lit(1 - top)).alias("_at")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_at")
    place = lambda i: F.min(F.when(F.col("_hi") > i, v)).cast("double")
    ends = sums.join(sizes, same(group)).groupBy(*group).agg(place(F.floor("_at")).alias("_a"), place(F.ceil("_at")).alias("_b"), F.max(F.col("_at") - F.floor("_at")).alias("_f"))
    q = cut(ends.select(*group, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("_q")))
    few = q.count() <= FEW_GROUPS
    return df.join(F.broadcast(q) if few else q, group).withColumn("kept", v >= F.col("_q")).drop("_q")


def minmax(value: str, group: list[str]) -> Column:
    """Value scaled to its group's range; a constant c gives 0 if it is 0, else min(1, c)."""
    w = W.partitionBy(*group)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(lo == hi, F.when(lo == 0, 0.0).otherwise(F.least(F.lit(1.0), lo))).otherwise((F.col(value) - lo) / (hi - lo + 1e-5))
