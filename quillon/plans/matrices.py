"""Queries of score matrices and selection. Stand-in for scores: mean discount x 10 of the lines of a cell, stage = order key mod 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix as X
from ..operators import rewards as R
from .common import HALVES_SQL, halves, table

TASKS = 5


def _cells(spark: SparkSession, sf_dir: str, future: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5 + 1).alias("after_task"), ((F.col("l_linenumber") - 1) % 5 + 1).cast("long").alias("eval_task"), "l_discount")
    c = li.groupBy("after_task", "eval_task").agg(F.round(F.avg("l_discount") * 10, 6).alias("score"))
    return c if future else c.filter("eval_task <= after_task")


def cl_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a stage."""
    p = X.pivot(_cells(spark, sf_dir), TASKS)
    return p.withColumn("average", F.round("average", 6))


def cl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages, transfer and forgetting (the full grid, so that forward transfer exists; no stage 0, so it is null)."""
    s = X.summary(_cells(spark, sf_dir, True), TASKS)
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def cl_missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With cell (4, 2) taken away, what is missing of primary, stage-0 and oracle cells."""
    have = _cells(spark, sf_dir).filter("not (after_task = 4 and eval_task = 2)").withColumn("mode", F.lit("primary"))
    return X.missing_cells(X.required_cells(spark, TASKS, True, True), have, ["mode", "after_task", "eval_task"])


def cl_cell_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full grid and a repeated first row as faults."""
    c = _cells(spark, sf_dir, True)
    return X.cell_faults(c.unionByName(c.filter("after_task = 1")))


def cl_best_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best, last and diagonal score of each task."""
    return R.best_and_final(_cells(spark, sf_dir), "eval_task", "after_task", "score")


def sel_lexicographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part brand the cheapest part of size up to 10, any if there is none."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return X.choose(p, ["p_brand"], F.col("p_size") <= 3, [F.col("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey", "p_size", "feasible")


def report_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the least and the greatest balance of each nation flagged."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("loss"), F.col("c_acctbal").alias("score"))
    b = X.best_marked(c, ["c_nationkey"], ["loss"], ["score"])
    return b.filter("best_loss or best_score").select("c_custkey", "best_loss", "best_score")


def sel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By brand, deviation and sign consistency of price less 1200."""
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") - 1200).alias("v"))
    s = X.selection_summary(p, "p_brand", "v")
    return s.select("p_brand", "n", *[F.round(c, 5).alias(c) for c in ("mean", "std", "sign_consistency")])


def sel_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and false atoms of first lines against opening words, weighed by quality."""
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", w(F.substring("text", 1, 60)).alias("gold"), w(F.substring("text", 31, 60)).alias("pred"), F.col("quality"))
    led = X.support_ledger(d.filter("quality is not null"), "doc_id", "gold", "pred", "quality")
    return led.groupBy("kind").agg(F.count("*").alias("n"), F.sum("weight").cast("double").alias("weight"))


def sel_support_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and false atoms of first halves against second halves, weighed by quality."""
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    a, b = halves("text")
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", w(a).alias("gold"), w(b).alias("pred"), F.col("quality"))
    led = X.support_ledger(d.filter("quality is not null"), "doc_id", "gold", "pred", "quality")
    return led.groupBy("kind").agg(F.count("*").alias("n"), F.sum("weight").cast("double").alias("weight"))


def sel_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines whose discount exceeds their tax by 0.03."""
    li = table(spark, sf_dir, "lineitem").withColumn("right", F.col("l_returnflag") == "R")
    return X.witnesses(li, "right", F.round(F.col("l_discount") - F.col("l_tax"), 6), 0.03).groupBy("l_linestatus").agg(F.count("*").alias("n"))


_C = "c as (select l_orderkey % 5 + 1 after_task, ((l_linenumber - 1) % 5 + 1)::bigint eval_task, round(avg(l_discount) * 10, 6) score from lineitem group by all)"
_W = "list_distinct(regexp_extract_all(lower({}), '[a-z]+'))"
QUERIES = {
    "cl_matrix_pivot": (cl_matrix_pivot, f"with {_C} select after_task, " + ", ".join(f"max(score) filter (eval_task = {t} and after_task >= {t}) r{t}" for t in range(1, 6)) + ", round(avg(score), 6) average from c where eval_task <= after_task group by 1"),
    "cl_summary": (cl_summary, f"""with {_C}, p as (select eval_task t, max(score) filter (after_task >= eval_task) b, max(score) filter (after_task = 5) f, max(score) filter (after_task = eval_task) d from c group by 1)
        select round(avg(f), 6) final_average, round(avg(d), 6) diagonal_average, round(avg(f - d) filter (t < 5), 6) bwt, round(avg(b - f) filter (t < 5), 6) forgetting, null::double fwt from p"""),
    "cl_missing_cells": (cl_missing_cells, """select 'primary' as mode, 4::bigint after_task, 2::bigint eval_task union all select 'primary', 0, i from range(1, 6) t(i) union all select 'oracle', a, e from range(1, 6) x(a), range(1, 6) y(e) where e <= a"""),
    "cl_cell_faults": (cl_cell_faults, "select 'future' fault, 14::bigint n union all select 'range', 0 union all select 'duplicate', 5"),
    "cl_best_final": (cl_best_final, f"with {_C} select eval_task, max(score) best, arg_max(score, after_task) as final, max(score) filter (after_task = eval_task) diagonal from c where eval_task <= after_task group by 1"),
    "sel_lexicographic": (sel_lexicographic, "with r as (select *, row_number() over (partition by p_brand order by (p_size > 3)::int, p_retailprice, p_partkey) i, max((p_size <= 3)::int) over (partition by p_brand) feasible from part) select p_brand, p_partkey, p_size, feasible from r where i = 1"),
    "report_best": (report_best, "with b as (select c_custkey, abs(c_acctbal - min(c_acctbal) over w) <= 1e-9 best_loss, abs(c_acctbal - max(c_acctbal) over w) <= 1e-9 best_score from customer window w as (partition by c_nationkey)) select * from b where best_loss or best_score"),
    "sel_summary": (sel_summary, "with v as (select p_brand, p_retailprice - 1200 v from part) select p_brand, count(*) n, round(avg(v), 5) mean, round(coalesce(stddev_samp(v), 0), 5) std, round(greatest(avg((v > 0)::int), avg((v < 0)::int)), 5) sign_consistency from v group by 1"),
    "sel_support": (sel_support, f"""with d as (select {_W.format('substring(text, 1, 60)')} g, {_W.format('substring(text, 31, 60)')} p, quality q from documents join labels using (doc_id) where quality is not null)
        select 'gold' kind, sum(len(g))::bigint n, sum(len(g) * (2 - q))::double weight from d union all select 'false', sum(len(list_filter(p, lambda x: not list_contains(g, x))))::bigint, sum(len(list_filter(p, lambda x: not list_contains(g, x))) * q)::double from d"""),
    "sel_witnesses": (sel_witnesses, "select l_linestatus, count(*) n from lineitem where l_returnflag = 'R' and round(l_discount - l_tax, 6) > 0.03 group by 1"),
}
QUERIES["sel_support_whole"] = (sel_support_whole, QUERIES["sel_support"][1].replace("substring(text, 1, 60)", HALVES_SQL[0]).replace("substring(text, 31, 60)", HALVES_SQL[1]))
