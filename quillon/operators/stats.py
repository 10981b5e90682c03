"""Aggregates: length statistics, percentiles of several definitions, confusion, correlation, concentration, effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def length_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, population deviation, min, max and size."""
    v = F.col(value).cast("double")
    return df.groupBy(*group).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("size"))


def percentiles(df: DataFrame, group: list[str], value: str, q: float) -> DataFrame:
    """Four percentiles: `nearest` (index ceil(qn) - 1), `linear`, `floor` (index int(qn)), `median_high` (index n // 2).

    Index forms need ranks only, so values are counted by (group, value) first and the rank
    windows run over distinct values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*group).orderBy(value)
    run = counts.withColumn("_hi", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(W.partitionBy(*group)))
    last = F.col("_n") - 1
    at = lambda i: F.min(F.when(F.col("_hi") > i, F.col(value)))
    low, high = F.floor(last * q), F.ceil(last * q)
    exact = run.groupBy(*group).agg(
        at(F.ceil(F.col("_n") * q) - 1).alias("nearest"), at(F.least(F.floor(F.col("_n") * q), last)).alias("floor"), at(F.floor(F.col("_n") / 2)).alias("median_high"),
        at(low).cast("double").alias("_lo"), at(high).cast("double").alias("_up"), F.max(last * q - low).alias("_f"),
    )
    return exact.withColumn("linear", F.col("_lo") + (F.col("_up") - F.col("_lo")) * F.col("_f")).drop("_lo", "_up", "_f")


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(true, pred, n, recall): counts, and the class recall on the diagonal."""
    cells = df.groupBy(true, pred).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(true))
    return cells.withColumn("recall", F.when(F.col(true).eqNullSafe(F.col(pred)), F.col("n") / total))


def micro_f1(df: DataFrame, group: list[str], gold: str, predicted: str) -> DataFrame:
    """2tp / (2tp + fp + fn) after summing sets over rows; 0 if the denominator is 0."""
    tp, fp, fn = F.size(F.array_intersect(gold, predicted)), F.size(F.array_except(predicted, gold)), F.size(F.array_except(gold, predicted))
    s = df.groupBy(*group).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    under = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return s.withColumn("f1", F.when(under > 0, 2 * F.col("tp") / under).otherwise(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b|; two empty sets are equal."""
    under = F.size(F.array_union(a, b))
    return F.when(under == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / under)


def pearson(df: DataFrame, group: list[str], x: str, y: str, name: str = "pearson") -> DataFrame:
    """Pearson correlation, null where either side is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.filter(a.isNotNull() & b.isNotNull())
    # merged means of a constant differ in their last bit, so its deviation need not be 0
    varies = ((F.min(a) < F.max(a)) & (F.min(b) < F.max(b))).alias("_v")
    s = both.groupBy(*group).agg(F.covar_pop(a, b).alias("_c"), F.stddev_pop(a).alias("_a"), F.stddev_pop(b).alias("_b"), varies)
    return s.select(*group, F.when(F.col("_v") & (F.col("_a") > 0) & (F.col("_b") > 0), F.col("_c") / (F.col("_a") * F.col("_b"))).alias(name))


def average_rank(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """df with the average rank of value in its group (E19): ranks come from counts of distinct values."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*group).orderBy(value)
    ranks = counts.withColumn(name, F.sum("_c").over(w) - (F.col("_c") - 1) / 2.0)
    keys = [*group, value]
    r = ranks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name)
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(r, match).select(*df.columns, name)


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y)
    ranked = average_rank(average_rank(both, group, x, "_rx"), group, y, "_ry")
    return pearson(ranked, group, "_rx", "_ry", "spearman")


def concentration(df: DataFrame, group: list[str], weight: str) -> DataFrame:
    """Herfindahl index and entropy of shares."""
    s = df.groupBy(*group).agg(F.sum(weight).alias("_t"))
    p = F.col(weight) / F.col("_t")
    joined = df.join(F.broadcast(s), group) if group else df.crossJoin(F.broadcast(s))  # one row without groups
    return joined.groupBy(*group).agg(F.sum(p * p).alias("hhi"), F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0)).alias("entropy"))


def effect_size(df: DataFrame, group: list[str], label: str, value: str) -> DataFrame:
    """AUROC and rank-biserial effect from average ranks; null if a class is empty."""
    r = average_rank(df.filter(F.col(value).isNotNull() & F.col(label).isNotNull()), group, value, "_r")
    n1, n0, s = F.sum(F.col(label).cast("long")), F.sum((1 - F.col(label)).cast("long")), F.sum(F.when(F.col(label) == 1, F.col("_r")))
    a = r.groupBy(*group).agg(n1.alias("n1"), n0.alias("n0"), s.alias("s"))
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0
    ok = (F.col("n1") > 0) & (F.col("n0") > 0)
    return a.select(*group, F.when(ok, u / (F.col("n1") * F.col("n0"))).alias("auroc"), F.when(ok, 2 * u / (F.col("n1") * F.col("n0")) - 1).alias("effect"))


def reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> Column:
    """The first failing reason in order, null if all hold."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules])


def counters(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(reason, n) of every rule in one pass."""
    sums = df.agg(*[F.coalesce(F.sum(F.coalesce(bad, F.lit(False)).cast("long")), F.lit(0)).alias(name) for name, bad in rules])
    pairs = ", ".join(f"'{name}', `{name}`" for name, _ in rules)
    return sums.selectExpr(f"stack({len(rules)}, {pairs}) as (reason, n)")


def diagnostics(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Count, mean and median overall and by each dimension: one scan with grouping sets."""
    sets = [[], *[[d] for d in dims]]
    level = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims], F.lit("all"))
    key = F.coalesce(*[F.when(F.grouping(d) == 0, F.coalesce(F.col(d).cast("string"), F.lit("null"))) for d in dims], F.lit(""))
    return df.groupingSets(sets, *dims).agg(level.alias("level"), key.alias("key"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median")).select("level", "key", "n", "mean", "median")


def weighted_ledger(df: DataFrame, group: list[str], weight: str, gain: str) -> DataFrame:
    """Sum of weight * gain, effective sample size and largest share."""
    w = F.col(weight)
    return df.groupBy(*group).agg(F.sum(w * F.col(gain)).alias("gain"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"), (F.max(w) / F.sum(w)).alias("max_share"))


def exact_match(df: DataFrame, group: list[str], response: str, label: str) -> DataFrame:
    """(group, n, n_right, accuracy): responses equal to their labels; a row without a response is wrong, one without a label doesn't count (M2)."""
    right = F.coalesce(F.col(response) == F.col(label), F.lit(False)).cast("long")
    return df.filter(F.col(label).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.sum(right).alias("n_right"), F.avg(right).alias("accuracy"))
