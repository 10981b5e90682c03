"""Attempt logs: latest and effective state, bursts, rolling limits, batch metrics, sessions, smoothing.

A log is append-only; `seq` is its explicit order. Running counts, sums, windows and
averages of a group are dealt out over ranges of its order (`scans`), so a group of a
third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import last_write
from .sampling import value_rank
from .scans import ROWS_PER_PART, affine_carries, decayed_totals, running, same, with_before


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key in append order."""
    return last_write(log, [key], seq)


def effective_latest(log: DataFrame, key: str, seq: str, batch: Column, in_cycle: Column, success: Column) -> DataFrame:
    """The state of the keys of started batches: the cycle's last row, else an earlier successful last row."""
    rest = F.struct(*log.columns)
    marked = log.withColumn("_batch", batch).withColumn("_in", in_cycle).withColumn("_ok", success)
    per_key = marked.groupBy(key, "_batch").agg(
        F.max_by(rest, F.when(F.col("_in"), F.col(seq))).alias("_mine"), F.max_by(F.struct(rest.alias("row"), F.col("_ok").alias("ok")), seq).alias("_any"), F.max("_in").alias("_started")
    )
    started = per_key.groupBy("_batch").agg(F.max("_started").alias("_go")).filter("_go").select("_batch")
    own = per_key.join(started, "_batch")
    chosen = F.when(F.col("_started"), F.col("_mine")).when(F.col("_any.ok"), F.col("_any.row"))
    return own.select(chosen.alias("_r"), (~F.col("_started")).alias("inherited")).filter("_r is not null").select("_r.*", "inherited")


def bursts(log: DataFrame, group: list[str], order: list[str], hit: str, ident: str, ts: str, recent: int = 20, minutes: int = 5, rows_per_part: int = ROWS_PER_PART, block: int = 1 << 16) -> DataFrame:
    """log with `burst`: three hits in a row, else five in the last `recent` rows, else three ids among those within `minutes`.

    A group is dealt out by blocks of its order, each of which also sees the rows just before it.
    """
    seen = with_before(log, group, order, max(recent - 1, 2), rows_per_part, block)
    w = W.partitionBy(*group, "_block").orderBy("_rank")
    back = w.rowsBetween(-(recent - 1), 0)
    row = F.col(hit) & F.coalesce(F.lag(hit, 1).over(w), F.lit(False)) & F.coalesce(F.lag(hit, 2).over(w), F.lit(False))
    many = F.sum(F.col(hit).cast("int")).over(back) >= 5
    seen = seen.withColumn("_row", row).withColumn("_many", many).withColumn("_last", F.collect_list(F.struct(F.col(hit).alias("h"), F.col(ident).alias("i"), F.col(ts).alias("t"))).over(back)).filter("not _halo")
    ids = F.size(F.array_distinct(F.transform(F.filter("_last", lambda x: x["h"] & (x["t"] >= F.col(ts) - F.expr(f"interval {minutes} minutes"))), lambda x: x["i"])))
    reason = F.when(F.col("_row"), "three_in_a_row").when(F.col("_many"), "five_in_recent").when(ids >= 3, "several_ids")
    return seen.withColumn("burst", reason).select(*log.columns, "burst")


def calls_in_window(log: DataFrame, group: list[str], ts: str, seconds: int, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """log with `in_window`: rows of the group in the trailing window, its far end excluded.

    A row adds one at its time and takes it off a window's length later, so the count is a running sum over the distinct times,
    dealt out in ranges: neither a dense span nor a group of many rows is one task. A row without a time counts none.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    met = log.filter(us.isNotNull()).groupBy(*group, us.alias("_us")).agg(F.count("*").alias("_d"))
    off = met.withColumn("_us", F.col("_us") + seconds * 1_000_000).withColumn("_d", -F.col("_d"))
    steps = met.unionByName(off).groupBy(*group, "_us").agg(F.sum("_d").alias("_d"))
    sums = running(steps, group, ["_us"], {"_c": F.col("_d")}, rows_per_part)
    counts = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_us").alias("_at"), "_c").hint("merge")
    seen = log.withColumn("_us", us).join(counts, same(group) & (F.col("_us") == F.col("_at")), "left")
    return seen.select(*log.columns, F.coalesce("_c", F.lit(0)).cast("long").alias("in_window"))


def debiased_ema(df: DataFrame, group: str, order: str, value: str, smooth: float, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(group, ema): the last debiased exponential average of each series (E13); no series is one list or one task. A null value counts as none."""
    totals = decayed_totals(df.select(group, order, value).filter(F.col(value).isNotNull()), [group], [order], F.col(value), smooth, rows_per_part)
    return totals.select(group, (F.col("x") / F.col("w")).alias("ema"))


def smoothed(df: DataFrame, group: list[str], order: list[str], value: str, smooth: float, name: str = "ema", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """df with the debiased exponential average up to each row (E13). A null value adds nothing but decays what came before.

    A step x -> smooth * x + value is an affine map. Ranges of a series are summed up to one map each, their maps are applied
    in turn (a row a range), and each range is then folded from what comes in.
    """
    own = affine_carries(df, group, order, F.col(value), smooth, rows_per_part)
    place, kept = {c: i for i, c in enumerate(own.columns)}, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = 0.0
        for batch in batches:
            v, first, came, rank = (batch.column(place[c]).to_pylist() for c in (value, "_i", "_in", "_rank"))
            out = []
            for one, i, start, r in zip(v, first, came, rank, strict=True):
                x = (start if i == 1 else x) * smooth + float(one or 0)
                out.append(x * (1 - smooth) / (1 - smooth**r))
            yield pa.RecordBatch.from_arrays([*[batch.column(place[c]) for c in kept], pa.array(out, pa.float64())], [*kept, name])

    return own.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def sessions(df: DataFrame, group: list[str], order: list[str], starts: Column, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """df with `session`: counts from the first row flagged as a start; rows before it are session 0."""
    return running(df, group, order, {"session": F.coalesce(starts, F.lit(False)).cast("long")}, rows_per_part)


def first_failure(log: DataFrame, run: str, seq: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(run, reason, seq) of the first row of each run that any rule matches; the first rule of a row wins."""
    why = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules])
    return log.withColumn("_w", why).filter("_w is not null").groupBy(run).agg(F.min_by("_w", seq).alias("reason"), F.min(seq).alias(seq))


def batch_metrics(log: DataFrame, batch: str, key: str, status: str, success: str, latency: str, seq: str) -> DataFrame:
    """Per batch: attempts, ids, successes of last states, success rate (1 if empty), retry amplification, index-form p95, gate."""
    last = log.groupBy(batch, key).agg(F.max_by(status, seq).alias("_last"), F.count("*").alias("_a"))
    states = last.groupBy(batch).agg(F.count("*").alias("n_ids"), F.sum("_a").alias("n_attempts"), F.sum((F.col("_last") == success).cast("long")).alias("n_success"))
    timed = log.filter(F.col(latency).isNotNull()).select(batch, seq, latency, F.sha2(F.col(seq).cast("string"), 256).alias("_d"))
    n = F.count("*")
    wanted = timed.groupBy(batch).agg((F.least(F.floor(n * 0.95), n - 1) + 1).alias("_i"))
    # ranks are dealt by ranges of the latency, and meet the wanted one by batch and rank: a batch of a third of all rows is no task
    p95 = value_rank(timed, [batch], [(latency, False)], "_d", [seq], "_i").join(wanted, [batch, "_i"]).select(batch, F.col(latency).alias("p95"))
    out = states.join(p95, batch, "left")
    rate = F.when(F.col("n_ids") == 0, 1.0).otherwise(F.col("n_success") / F.col("n_ids"))
    return out.withColumn("success_rate", rate).withColumn("amplification", F.col("n_attempts") / F.col("n_ids")).withColumn("complete", F.col("n_success") == F.col("n_ids"))


def budget(log: DataFrame, group: list[str], order: list[str], cost: Column, limit: float, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """log with `spent`, `remaining` and whether an extra attempt is `allowed`."""
    return running(log, group, order, {"spent": cost}, rows_per_part).withColumn("remaining", F.lit(limit) - F.col("spent")).withColumn("allowed", F.col("remaining") > 0)
