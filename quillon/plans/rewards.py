"""Queries of the reward operators; an order is a prompt, its lines are completions, discount and tax are rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rewards as R
from .common import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prompt"), F.col("l_linenumber").cast("long").alias("line"), "l_quantity", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("r1"), F.when(F.col("l_quantity") <= 45, F.col("l_tax")).alias("r2"))
    return li.withColumn("reward", R.combined(["r1", "r2"], [1.0, 0.5]))


def _out(df: DataFrame) -> DataFrame:
    return df.select("prompt", "line", F.round("advantage", 5).alias("advantage"))


def rl_advantage_grpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group mean and group deviation."""
    return _out(R.advantages(_lines(spark, sf_dir), "prompt", "reward"))


def rl_advantage_rloo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one out, no scaling."""
    a = R.advantages(_lines(spark, sf_dir), "prompt", "reward", "rloo", "none")
    return a.select("prompt", "line", F.round("advantage", 9).alias("advantage"))


def rl_advantage_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group mean, deviation of the whole batch."""
    return _out(R.advantages(_lines(spark, sf_dir), "prompt", "reward", "grpo", "batch"))


def rl_advantage_rpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled by the deviation of the advantages."""
    return _out(R.advantages(_lines(spark, sf_dir), "prompt", "reward", "reinforce_plus_plus", "batch"))


def rl_advantage_gdpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards normalised one by one."""
    return R.gdpo(_lines(spark, sf_dir), "prompt", ["r1", "r2"], [1.0, 0.5]).select("prompt", "line", F.round("advantage", 4).alias("advantage"))


def rl_advantage_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers 1 to 2, 3 to 4, ... are one request of a prompt."""
    li = _lines(spark, sf_dir).withColumn("request", F.col("prompt") * 10 + F.floor((F.col("line") - 1) / 2)).withColumn("at", F.col("line") * 1000000000 + F.col("price"))
    return _out(R.dynamic_advantages(li, "request", "at", "prompt", "reward"))


def rl_reward_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.reward_metrics(_lines(spark, sf_dir), "prompt", "reward")
    return m.select(*[F.round(c, 6).alias(c) for c in ("reward", "reward_std", "frac_zero_std")], "n_groups")


def rl_zero_std_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompts whose first rewards differ."""
    return R.varied_groups(_lines(spark, sf_dir), "prompt", "r1").select("prompt", "line")


def rl_cosine_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity as length, returned lines as right answers."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("prompt"), F.col("l_linenumber").cast("long").alias("line"), F.round(R.cosine_length(F.col("l_quantity"), F.col("l_returnflag") == "R", 50), 6).alias("reward"))


def rl_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity as length, 50 at most with a cache of 20."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("prompt"), F.col("l_linenumber").cast("long").alias("line"), F.round(R.soft_overlong(F.col("l_quantity"), 50, 20), 6).alias("penalty"))


def rl_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector as new log-probabilities, its reverse as old ones."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", F.round(R.kl3(v, F.reverse(v)), 5).alias("kl"))


def rl_entropy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth of lines with the highest price, by flag, kept."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return R.entropy_mask(li, ["l_returnflag"], "l_extendedprice", 0.2).groupBy("l_returnflag").agg(F.sum(F.col("kept").cast("long")).alias("n_kept"), F.count("*").alias("n"))


def rl_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts scaled within an order."""
    li = _lines(spark, sf_dir)
    return li.select("prompt", "line", F.round(R.minmax("r1", ["prompt"]), 6).alias("scaled"))


_L = "l as (select l_orderkey prompt, l_linenumber::bigint line, l_discount r1, l_extendedprice price, case when l_quantity <= 45 then l_tax end r2, l_discount + coalesce(case when l_quantity <= 45 then l_tax end * 0.5::double, 0) reward from lineitem)"
_G = "partition by prompt"
QUERIES = {
    "rl_advantage_grpo": (rl_advantage_grpo, f"with {_L} select prompt, line, round((reward - avg(reward) over ({_G})) / (coalesce(stddev_samp(reward) over ({_G}), 0) + 1e-4::double), 5) advantage from l"),
    "rl_advantage_rloo": (rl_advantage_rloo, f"with {_L}, g as (select *, count(*) over ({_G}) k, avg(reward) over ({_G}) m from l) select prompt, line, round(case when k > 1 then (reward - m) * k / (k - 1) else reward - m end, 9) advantage from g"),
    "rl_advantage_batch": (rl_advantage_batch, f"with {_L} select prompt, line, round((reward - avg(reward) over ({_G})) / (stddev_samp(reward) over () + 1e-4::double), 5) advantage from l"),
    "rl_advantage_rpp": (rl_advantage_rpp, f"with {_L}, a as (select prompt, line, reward - avg(reward) over ({_G}) a from l) select prompt, line, round(a / (stddev_samp(a) over () + 1e-4::double), 5) advantage from a"),
    "rl_advantage_gdpo": (rl_advantage_gdpo, f"""with {_L}, z as (select prompt, line, coalesce((r1 - avg(r1) over ({_G})) / (coalesce(stddev_samp(r1) over ({_G}), 0) + 1e-8::double), 0) + coalesce((r2 - avg(r2) over ({_G})) / (coalesce(stddev_samp(r2) over ({_G}), 0) + 1e-8::double) * 0.5, 0) t from l)
        select prompt, line, round((t - avg(t) over ()) / (stddev_samp(t) over () + 1e-8::double), 4) advantage from z"""),
    "rl_advantage_dynamic": (rl_advantage_dynamic, f"""with {_L}, q as (select *, prompt * 10 + (line - 1) // 2 request from l), r as (select request, arg_max(prompt, line * 1000000000 + price) prompt, arg_max(reward, line * 1000000000 + price) reward from q group by 1),
        a as (select request, (reward - avg(reward) over ({_G})) / (coalesce(stddev_samp(reward) over ({_G}), 0) + 1e-4::double) a from r) select prompt, line, round(a, 5) advantage from q join a using (request)"""),
    "rl_reward_metrics": (rl_reward_metrics, f"with {_L}, g as (select avg(reward) m, coalesce(stddev_samp(reward), 0) s from l group by prompt) select round(avg(m), 6) reward, round(stddev_samp(m), 6) reward_std, round(avg((abs(s) <= 1e-8)::int), 6) frac_zero_std, count(*) n_groups from g"),
    "rl_zero_std_filter": (rl_zero_std_filter, f"with {_L} select prompt, line from l where prompt in (select prompt from l group by 1 having max(r1) > min(r1))"),
    "rl_cosine_reward": (rl_cosine_reward, "select l_orderkey prompt, l_linenumber::bigint line, round(case when l_returnflag = 'R' then 1.0::double - 0.5::double * (1 - cos(l_quantity * pi() / 50)) / 2 else -0.5::double - (-0.5::double) * (1 - cos(l_quantity * pi() / 50)) / 2 end, 6) reward from lineitem"),
    "rl_overlong": (rl_overlong, "select l_orderkey prompt, l_linenumber::bigint line, round(least(-(l_quantity - 30) / 20, 0), 6) penalty from lineitem"),
    "rl_kl": (rl_kl, "with d as (select vec_id, unnest(embedding)::double a, unnest(list_reverse(embedding))::double b from embeddings) select vec_id, round(avg(exp(b - a) - (b - a) - 1), 5) kl from d group by 1"),
    "rl_entropy_mask": (rl_entropy_mask, "with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.8) q from lineitem group by 1) select l_returnflag, count(*) filter (l_extendedprice >= q) n_kept, count(*) n from lineitem join q using (l_returnflag) group by 1"),
    "rl_minmax": (rl_minmax, f"with {_L}, m as (select *, min(r1) over ({_G}) lo, max(r1) over ({_G}) hi from l) select prompt, line, round(case when lo = hi then case when lo = 0 then 0 else least(1, lo) end else (r1 - lo) / (hi - lo + 1e-5::double) end, 6) scaled from m"),
}
