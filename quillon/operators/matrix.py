"""Continual-learning score matrices R[after_task, eval_task] as long tables, and selection among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def required_cells(spark: SparkSession, tasks: int, stage_zero: bool = False, oracle: bool = False) -> DataFrame:
    """(mode, after_task, eval_task) of the lower triangle, with stage 0 and oracle cells if asked for (M9)."""
    grid = spark.range(1, tasks + 1).select(F.col("id").alias("after_task")).withColumn("eval_task", F.explode(F.sequence(F.lit(1).cast("long"), F.col("after_task"))))
    out = grid.select(F.lit("primary").alias("mode"), "after_task", "eval_task")
    if stage_zero:
        out = out.unionByName(spark.range(1, tasks + 1).select(F.lit("primary").alias("mode"), F.lit(0).cast("long").alias("after_task"), F.col("id").alias("eval_task")))
    return out.unionByName(grid.select(F.lit("oracle").alias("mode"), "after_task", "eval_task")) if oracle else out


def missing_cells(required: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Required cells without a score."""
    return required.join(cells.filter(F.col("score").isNotNull()).select(*keys).distinct(), keys, "left_anti")


def pivot(cells: DataFrame, tasks: int) -> DataFrame:
    """One row a stage: R1..Rn with nulls above the diagonal, and the mean over the tasks seen."""
    cols = [F.max(F.when((F.col("eval_task") == t) & (F.col("after_task") >= t), F.col("score"))).alias(f"r{t}") for t in range(1, tasks + 1)]
    seen = F.avg(F.when(F.col("eval_task") <= F.col("after_task"), F.col("score"))).alias("average")
    return cells.groupBy("after_task").agg(*cols, seen)


def summary(cells: DataFrame, tasks: int) -> DataFrame:
    """Average, forgetting, backward and (where cells above the diagonal exist) forward transfer."""
    s, a, e = F.col("score"), F.col("after_task"), F.col("eval_task")
    per = cells.groupBy("eval_task").agg(
        F.max(F.when(a >= e, s)).alias("best"), F.max(F.when(a == tasks, s)).alias("final"), F.max(F.when(a == e, s)).alias("diagonal"),
        F.max(F.when(a == e - 1, s)).alias("before"), F.max(F.when(a == 0, s)).alias("zero"),
    )
    old = F.col("eval_task") < tasks
    return per.agg(
        F.avg("final").alias("final_average"), F.avg("diagonal").alias("diagonal_average"), F.avg(F.when(old, F.col("final") - F.col("diagonal"))).alias("bwt"),
        F.avg(F.when(old, F.col("best") - F.col("final"))).alias("forgetting"), F.avg(F.when(F.col("eval_task") >= 2, F.col("before") - F.col("zero"))).alias("fwt"),
    )


def cell_faults(cells: DataFrame) -> DataFrame:
    """(fault, n): cells above the diagonal, repeated cells, scores outside 0..1."""
    dup = cells.groupBy("after_task", "eval_task").agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("duplicate").alias("fault"), F.count("*").alias("n"))
    one = cells.agg(F.sum((F.col("eval_task") > F.col("after_task")).cast("long")).alias("future"), F.sum((~F.col("score").between(0, 1)).cast("long")).alias("range"))
    return one.selectExpr("stack(2, 'future', future, 'range', `range`) as (fault, n)").unionByName(dup)


def best_marked(df: DataFrame, group: list[str], lower_better: list[str], higher_better: list[str]) -> DataFrame:
    """df with a flag `best_<metric>` per metric: the group's minimum loss or maximum score, within 1e-9."""
    w = W.partitionBy(*group)
    for m in lower_better:
        df = df.withColumn(f"best_{m}", F.abs(F.col(m) - F.min(m).over(w)) <= 1e-9)
    for m in higher_better:
        df = df.withColumn(f"best_{m}", F.abs(F.col(m) - F.max(m).over(w)) <= 1e-9)
    return df


def choose(df: DataFrame, group: list[str], feasible: Column, order: list[Column]) -> DataFrame:
    """The first row of each group by feasibility, then by the order."""
    key = F.struct((~feasible).cast("int").alias("f"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*group).agg(F.min_by(F.struct(*[c for c in df.columns if c not in group]), key).alias("_c"), F.max(feasible.cast("int")).alias("feasible")).select(*group, "_c.*", "feasible")


def selection_summary(df: DataFrame, item: str, value: str) -> DataFrame:
    """Per item over repeats: how often chosen, sample deviation, sign consistency."""
    return df.groupBy(item).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.greatest(F.avg((F.col(value) > 0).cast("double")), F.avg((F.col(value) < 0).cast("double"))).alias("sign_consistency"),
    )


def support_ledger(df: DataFrame, sample: str, gold: str, predicted: str, quality: str) -> DataFrame:
    """(sample, atom, kind, weight): each gold atom weighs 2 - q, each false one q."""
    g = df.select(sample, F.col(quality).alias("_q"), F.explode(gold).alias("atom"), F.lit("gold").alias("kind"))
    fp = df.select(sample, F.col(quality).alias("_q"), F.explode(F.array_except(predicted, gold)).alias("atom"), F.lit("false").alias("kind"))
    both = g.unionByName(fp)
    return both.select(sample, "atom", "kind", F.when(F.col("kind") == "gold", 2 - F.col("_q")).otherwise(F.col("_q")).alias("weight"))


def witnesses(df: DataFrame, correct: str, margin: Column, eta: float) -> DataFrame:
    """Rows that are right and gain more than eta."""
    return df.filter(F.col(correct) & (margin > eta))
