"""Evaluation by task, validation reports, gates, logit comparisons, image hashes, user-defined aggregates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import metrics as M

SCORE_KEYS = ("score", "accuracy", "all_concept_micro_f1", "micro_f1", "combined_score", "mean_iou", "final_answer_accuracy")


def evaluate(df: DataFrame) -> DataFrame:
    """(task_id, total, nonempty, metric_a, metric_b, primary_score, status) of rows (task_id, prompt, reference, prediction, boxes) (M8).

    Tasks 1 and 2: answer accuracy. 3: micro-F1 of all and of core concepts; the first is primary. 4: share of boxes met with
    IoU 0.5, and mean IoU. 5: answer accuracy, and ROUGE-L of the reasoning. Two metrics of tasks 4 and 5 are averaged.
    """
    ref, raw, task = F.col("reference"), F.coalesce("prediction", F.lit("")), F.col("task_id")
    options = X.option_map(F.col("prompt"))
    right = X.answer_matches(options, ref, raw).cast("double")
    sets = {k: (X.concept_set(raw, core=k == "core"), X.concept_set(ref, core=k == "core")) for k in ("all", "core")}
    counts = [x.alias(f"{k}_{n}") for k, (p, r) in sets.items() for n, x in (("tp", F.size(F.array_intersect(p, r))), ("fp", F.size(F.array_except(p, r))), ("fn", F.size(F.array_except(r, p))))]
    prepared = df.select("task_id", raw.alias("raw"), right.alias("right"), *counts, M.match_boxes(M.boxes_in(raw), "boxes").alias("box"), M.rouge_l(X.norm_ascii(X.reasoning_part(ref)), X.norm_ascii(X.reasoning_part(raw))).alias("rouge"))
    f1 = lambda k: F.sum(F.col(f"{k}_tp")) * 2 / F.nullif(F.sum(2 * F.col(f"{k}_tp") + F.col(f"{k}_fp") + F.col(f"{k}_fn")), F.lit(0))
    s = prepared.groupBy("task_id").agg(
        F.count("*").alias("total"), F.sum((F.trim("raw") != "").cast("long")).alias("nonempty"), F.avg("right").alias("_acc"), F.coalesce(f1("all"), F.lit(0.0)).alias("_all"), F.coalesce(f1("core"), F.lit(0.0)).alias("_core"),
        F.avg("box.hit_rate").alias("_hit"), F.avg("box.optimal").alias("_iou"), F.avg("rouge").alias("_rouge"),
    )
    a = F.when(task <= 2, F.col("_acc")).when(task == 3, F.col("_all")).when(task == 4, F.col("_hit")).otherwise(F.col("_acc"))
    b = F.when(task == 3, F.col("_core")).when(task == 4, F.col("_iou")).when(task == 5, F.col("_rouge"))
    primary = F.when(task <= 3, a).otherwise((a + b) / 2)
    return s.select("task_id", "total", "nonempty", a.alias("metric_a"), b.alias("metric_b"), primary.alias("primary_score"), F.when(F.col("nonempty") == F.col("total"), "PASS").otherwise("FAIL").alias("status"))


def first_score(payload: Column) -> Column:
    """The first numeric score among the known keys of a JSON payload, else of its `metrics`."""
    keys = [f"$.{k}" for k in SCORE_KEYS] + [f"$.metrics.{k}" for k in SCORE_KEYS]
    return F.coalesce(*[F.try_to_number(F.get_json_object(payload, k), F.lit("S999999999D999999999")).cast("double") for k in keys])


def output_diagnostics(df: DataFrame, group: list[str], response: str) -> DataFrame:
    """Mean and greatest length, and how many outputs are empty."""
    n = F.length(F.coalesce(response, F.lit("")))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.avg(n).alias("mean_length"), F.max(n).cast("long").alias("max_length"), F.sum((n == 0).cast("long")).alias("n_empty"))


def gates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(gate, passed): aggregate conditions over all rows in one pass, and `ALL`."""
    one = df.agg(*[c.alias(name) for name, c in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    rows = one.selectExpr(f"stack({len(rules)}, {pairs}) as (gate, passed)")
    return rows.unionByName(rows.agg(F.lit("ALL").alias("gate"), F.min("passed").alias("passed")))


def validation(df: DataFrame, errors: dict[str, Column]) -> DataFrame:
    """(check, n_errors, status): a dataset passes iff no check finds a row."""
    from .stats import counters

    c = counters(df, list(errors.items())).select(F.col("reason").alias("check"), F.col("n").alias("n_errors"))
    return c.withColumn("status", F.when(F.col("n_errors") == 0, "PASS").otherwise("FAIL"))


def centred(a: Column) -> Column:
    """A vector less its mean."""
    return X.let(a, lambda v: X.let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v), lambda m: F.transform(v, lambda x: x - m)))


def log_softmax(a: Column) -> Column:
    return X.let(a, lambda v: X.let(F.array_max(v), lambda m: X.let(F.ln(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - m))) + m, lambda z: F.transform(v, lambda x: x - z))))


def softmax_kl(reference: Column, actual: Column) -> Column:
    """KL from the reference's softmax to the other's, 0 at least."""
    both = F.zip_with(log_softmax(reference), log_softmax(actual), lambda p, q: F.exp(p) * (p - q))
    return F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x))


def centred_mse(a: Column, b: Column) -> Column:
    d = F.zip_with(centred(a), centred(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def interaction_norm(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Squared norm of b - c - d + a after centring each."""
    left = F.zip_with(centred(b), centred(c), lambda x, y: x - y)
    right = F.zip_with(centred(a), centred(d), lambda x, y: x - y)
    return F.aggregate(F.zip_with(left, right, lambda x, y: (x + y) * (x + y)), F.lit(0.0), lambda s, x: s + x)


def mean_sd(mean: Column, sd: Column) -> Column:
    """`0.12±0.03`."""
    return F.concat(F.format_string("%.2f", mean), F.lit("±"), F.format_string("%.2f", sd))


def dct_hash(pixels: np.ndarray) -> str:
    """64-bit perceptual hash of a 32 by 32 grey image: low DCT terms against the median of all but the first (I8)."""
    n = pixels.shape[0]
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))
    low = (basis @ pixels @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


@F.pandas_udf(T.StringType())
def perceptual_hash(pixels: pd.Series) -> pd.Series:
    """dct_hash of flat arrays of 1,024 grey values."""
    return pd.Series([None if p is None else dct_hash(np.asarray(p, dtype=np.float64).reshape(32, 32)) for p in pixels])


def global_similarity(a: Column, b: Column) -> Column:
    """Similarity of two equal-sized grey images from means, variances and covariance."""
    c1, c2 = 6.5025, 58.5225
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    cov = lambda v, w: mean(F.zip_with(v, w, lambda x, y: x * y)) - mean(v) * mean(w)
    ma, mb = mean(a), mean(b)
    return (2 * ma * mb + c1) * (2 * cov(a, b) + c2) / ((ma * ma + mb * mb + c1) * (cov(a, a) + cov(b, b) + c2))


class Aggregate:
    """A user-defined aggregate: partial states by partition, merged where they meet.

    update(state, frame) takes a pandas frame, merge(a, b) two states, compute(state) gives a dict. States are JSON-like.
    """

    def __init__(self, zero: Callable[[], object], update: Callable, merge: Callable, compute: Callable):
        self.zero, self.update, self.merge, self.compute = zero, update, merge, compute

    def run(self, df: DataFrame, fan: int = 64) -> dict:
        """compute of all rows' state: partitions' states merge in `fan` tasks, and the driver gets one of each."""
        import functools
        import json

        def part(frames):
            state = self.zero()
            for f in frames:
                state = self.update(state, f)
            yield pd.DataFrame({"state": [json.dumps(state)]})

        def meet(frames):
            yield pd.DataFrame({"state": [json.dumps(functools.reduce(self.merge, (json.loads(s) for f in frames for s in f["state"]), self.zero()))]})

        states = df.mapInPandas(part, "state string").repartition(fan).mapInPandas(meet, "state string")  # a row a partition is shuffled
        return self.compute(functools.reduce(self.merge, (json.loads(r.state) for r in states.collect()), self.zero()))


class Registry:
    """Named plug-ins of one kind: rewards, metrics, loss scales (2.15)."""

    def __init__(self, kind: str):
        self.kind, self._by_name = kind, {}

    def add(self, name: str, f: Callable, exist_ok: bool = False) -> Callable:
        if name in self._by_name and not exist_ok:
            raise ValueError(f"{self.kind} {name} is registered already")
        self._by_name[name] = f
        return f

    def get(self, spec: str) -> list[Callable]:
        """The plug-ins of `a+b`."""
        missing = [n for n in spec.split("+") if n not in self._by_name]
        if missing:
            raise KeyError(f"no {self.kind} named {', '.join(missing)}")
        return [self._by_name[n] for n in spec.split("+")]
