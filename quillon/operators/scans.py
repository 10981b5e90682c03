"""Scans over an order, dealt out: running sums and neighbours of groups of any size.

A scan takes two passes. Rows are range-partitioned by (group, order) at sampled
bounds, so that parts hold about `rows_per_part` rows whatever the group's or the
key's distribution; each part is summed up on its own; the parts' sums are scanned
(a row a part and group); and each row adds its part's carry. No group, however
large, is one task. Rows that tie in the whole order share a part, so the order
should end with a unique column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Rows a part holds about.
ROWS_PER_PART = 1_000_000


def parts(df: DataFrame, group: list[str], order: list, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """df with `_part`: numbers of ranges of (group, order), rising with them; written to the checkpoint folder, so that the ranges stay."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, math.ceil(df.count() / rows_per_part))
    return cut(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, group: list[str], order: list, sums: dict[str, Column], rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """df with a column for each of `sums`: the expression's sum over the group's rows up to this one in the order.

    `order` are column names or sort expressions. A null adds nothing. An empty group list means the whole table.
    """
    dealt = parts(df, group, order, rows_per_part)
    each = dealt.groupBy("_part", *group).agg(*[F.sum(x).alias(f"_s{i}") for i, x in enumerate(sums.values())])
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    carry = each.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[F.coalesce(F.sum(f"_s{i}").over(before), zero).alias(f"_c{i}") for i in range(len(sums))])
    match = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = W.partitionBy("_part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = dealt.select("*", *[F.coalesce(F.sum(x).over(own), zero).alias(f"_r{i}") for i, x in enumerate(sums.values())])
    return summed.join(carry, match).select(*df.columns, *[(F.col(f"_r{i}") + F.col(f"_c{i}")).alias(name) for i, name in enumerate(sums)])


def ranked(df: DataFrame, group: list[str], order: list, name: str = "rank", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """df with each row's rank (from 1) in its group."""
    return running(df, group, order, {name: F.lit(1).cast("long")}, rows_per_part)


def with_before(df: DataFrame, group: list[str], order: list, reach: int, rows_per_part: int = ROWS_PER_PART, block: int = 1 << 16) -> DataFrame:
    """df with `_rank`, `_block` and `_halo`: blocks of `block` rows of a group, each with the `reach` rows before it once more.

    A window over (group, _block) ordered by _rank sees up to `reach` rows back as if over the whole group; rows with
    `_halo` are there to be looked at and should be filtered after that.
    """
    if reach >= block:
        raise ValueError("the rows looked back at must be fewer than a block's")
    own = ranked(df, group, order, "_rank", rows_per_part)
    at = F.col("_rank") - 1
    ahead = F.when(at % block >= block - reach, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = own.withColumn("_ahead", F.explode(ahead)).withColumn("_block", F.floor(at / block) + F.col("_ahead"))
    return both.withColumn("_halo", F.col("_ahead") == 1).drop("_ahead")


def decayed_totals(df: DataFrame, group: list[str], order: list, value: Column, decay: float, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(group, x, w): sums of value * decay^k and of decay^k, k rows after each; what a fold x -> decay * x + value leaves at the end.

    The fold's steps are affine maps, whose composition needs only each row's distance from the end: its rank and the group's size.
    """
    own = ranked(df.withColumn("_v", value.cast("double")), group, order, "_rank", rows_per_part)
    last = own.groupBy(*group).agg(F.max("_rank").alias("_n"))
    met = own.join(F.broadcast(last), F.lit(True)) if not group else own.join(last.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_n"), same(group))
    k = F.pow(F.lit(decay), (F.col("_n") - F.col("_rank")).cast("double"))
    return met.groupBy(*group).agg(F.sum(F.col("_v") * k).alias("x"), F.sum(k).alias("w"))


def affine_carries(df: DataFrame, group: list[str], order: list, value: Column, decay: float, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """df with `_rank` in the group, `_i` in its range, and `_in`, what x -> decay * x + value leaves before the range; sorted by range and order.

    Each task's rows are whole ranges in order, so a fold needs `_in` at `_i` = 1 alone.
    """
    dealt = parts(df, group, order, rows_per_part)
    own = W.partitionBy("_part", *group)
    placed = dealt.withColumn("_i", F.row_number().over(own.orderBy(*order)).cast("long")).withColumn("_m", F.count("*").over(own))
    power = F.pow(F.lit(decay), (F.col("_m") - F.col("_i")).cast("double"))
    ends = placed.groupBy("_part", *group).agg(F.sum(F.coalesce(value.cast("double"), F.lit(0.0)) * power).alias("x"), F.count("*").alias("n"))
    # a group's ranges in order: one entry a range
    listed = ends.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_part", "x", "n"))).alias("_l"))
    kind = "struct<x:double,n:bigint,out:array<struct<p:int,x:double,n:bigint>>>"
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<p:int,x:double,n:bigint>>").alias("out")).cast(kind)

    def step(a, e):
        out = F.array_append(a["out"], F.struct(e["_part"].alias("p"), a["x"].alias("x"), a["n"].alias("n")))
        return F.struct((a["x"] * F.pow(F.lit(decay), e["n"].cast("double")) + e["x"]).alias("x"), (a["n"] + e["n"]).alias("n"), out.alias("out")).cast(kind)

    came = listed.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.explode(F.aggregate("_l", start, step, lambda a: a["out"])).alias("_c"))
    met = placed.join(came, same(group) & (F.col("_part") == F.col("_c.p")))
    out = met.select(*df.columns, "_part", (F.col("_i") + F.col("_c.n")).alias("_rank"), "_i", F.col("_c.x").alias("_in"))
    return out.repartition("_part").sortWithinPartitions("_part", *group, "_i")


def same(group: list[str]) -> Column:
    """Whether a row's group columns equal the renamed ones (_g0, _g1, ...) of the other side; nulls are equal."""
    match = F.lit(True)
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return match
