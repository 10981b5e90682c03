"""Sequence packing under a token budget: order-keeping next-fit, by shard or over one whole order, and best-fit decreasing; packed rows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .scans import ROWS_PER_PART, ranked, running


def next_fit(df: DataFrame, shard: str, order: str, length: str, budget: int) -> DataFrame:
    """df with `pack` (number within the shard): a pack closes when the next row doesn't fit or it is full; a row over the
    budget stands alone (E7). A shard is a bounded set of rows by its definition; its fold runs in one expression."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(length).cast("long").alias("n"))))
    zero = F.struct(F.lit(0).cast("long").alias("pack"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:bigint,pack:bigint>>").alias("out"))

    def step(a, x):
        opens = (a["used"] > 0) & (a["used"] + x["n"] > budget)
        pack, used = a["pack"] + F.when(opens, 1).otherwise(0), F.when(opens, x["n"]).otherwise(a["used"] + x["n"])
        full = used >= budget
        return F.struct((pack + F.when(full, 1).otherwise(0)).alias("pack"), F.when(full, F.lit(0).cast("long")).otherwise(used).alias("used"), F.array_append(a["out"], F.struct(x["o"].cast("long").alias("o"), pack.alias("pack"))).alias("out"))

    packed = df.groupBy(shard).agg(rows.alias("_r")).select(shard, F.explode(F.aggregate("_r", zero, step, lambda a: a["out"])).alias("p"))
    return df.join(packed.select(shard, F.col("p.o").alias(order), F.col("p.pack").alias("pack")), [shard, order])


def next_fit_order(df: DataFrame, order: list, length: str, budget: int, name: str = "pack", packs_per_part: int = 4096, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """df with `pack` (from 0) of one next-fit packing over the whole order (E7): as next_fit, but of all rows, and dealt out.

    Running sums give each row its place on the line of all lengths, cut into ranges of `packs_per_part` budgets. The row that
    opens the next pack after a pack that opens here is found by search, within the range or at the beginning of the
    following one, which each range also holds. So a range tells for each row that may be entered first where the following
    ranges are entered; entries are linked by joins that double their reach, from the first row on; and each range
    finds its packs' first rows from its true entry. A running count of these numbers the packs. Rows of length null or 0 that follow each other act as one.
    """
    n = F.coalesce(F.col(length).cast("long"), F.lit(0))
    line = running(df, [], order, {"_r": F.lit(1).cast("long"), "_end": n, "_pos": (n > 0).cast("long")}, rows_per_part)
    line = cut(line.withColumn("_n", n).withColumn("_at", F.col("_end") - n))
    empty = line.filter("_n = 0").groupBy("_pos").agg(F.min("_r").alias("_first"), F.count("*").alias("_many"))
    empty = cut(empty)
    lead = line.filter("_n > 0").select("_r", "_at", "_n").unionByName(line.filter("_n = 0").join(empty, F.col("_r") == F.col("_first"), "left_semi").select("_r", "_at", "_n"))
    # ranks of the rows that are left, as only these follow each other
    lead = cut(ranked(lead, [], ["_r"], "_k", rows_per_part))
    width = budget * packs_per_part
    part = F.floor(F.col("_at") / width)
    early = F.col("_at") % width < budget
    held = lead.withColumn("_own", F.lit(True)).withColumn("_part", part).unionByName(lead.filter(early & (part > 0)).withColumn("_own", F.lit(False)).withColumn("_part", part - 1))
    held = held.select("_part", "_own", "_k", "_r", "_at", "_n")

    def follow(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pdf.sort_values("_k", ignore_index=True)
        at, size, k = (pdf[c].to_numpy(np.int64) for c in ("_at", "_n", "_k"))
        # the first later row that starts a budget further on, or would end beyond it
        i = np.arange(len(pdf))
        far = np.minimum(np.searchsorted(at, at + budget, "left"), np.searchsorted(at + size, at + budget, "right"))
        return pdf, np.maximum(far, i + 1)

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, after = follow(pdf)
        k, own = pdf["_k"].to_numpy(np.int64), pdf["_own"].to_numpy(bool)
        m = int(own.sum())  # own rows come first
        leaves = np.empty(m, np.int64)
        for i in range(m - 1, -1, -1):
            leaves[i] = leaves[after[i]] if after[i] < m else k[i] + (after[i] - i)
        may = (pdf["_at"].to_numpy(np.int64)[:m] % width < budget) | (np.arange(m) == 0)
        return pd.DataFrame({"_part": pdf["_part"][:m][may], "_k": k[:m][may], "_to": leaves[may]})

    jumps = cut(held.groupBy("_part").applyInPandas(entries, "_part long, _k long, _to long"))
    reached, jump, seen = cut(jumps.filter("_k = 1").select("_k")), jumps.select("_k", "_to"), 0
    while (found := reached.count()) > seen:
        seen = found
        onward = reached.join(jump, "_k").select(F.col("_to").alias("_k")).join(jumps.select("_k"), "_k", "left_semi")
        reached = cut(reached.union(onward).distinct())
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a._to") == F.col("b._k")).select("a._k", "b._to"))

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, after = follow(pdf)
        i, m, out = int(np.searchsorted(pdf["_k"].to_numpy(np.int64), int(pdf["_entry"].iloc[0]))), int(pdf["_own"].sum()), []
        while i < m:
            out.append(i)
            i = int(after[i])
        return pdf.iloc[out][["_r"]].rename(columns={"_r": "_begin"})

    entered = jumps.join(reached, "_k").select("_part", F.col("_k").alias("_entry"))
    opened = held.join(entered, "_part").groupBy("_part").applyInPandas(starts, "_begin long")
    flagged = line.join(opened, F.col("_r") == F.col("_begin"), "left").select(*df.columns, "_r", F.col("_begin").isNotNull().cast("long").alias("_open"))
    return running(flagged, [], ["_r"], {name: F.col("_open")}, rows_per_part).select(*df.columns, (F.col(name) - 1).alias(name))


def best_fit(lengths: list[int], budget: int) -> list[int]:
    """The bin of each item, longest first, each into the fullest bin it fits (E8). Bins over the budget hold one item."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    space: list[tuple[int, int]] = []  # (free, bin), sorted
    out, n = [0] * len(lengths), 0
    for i in order:
        at = bisect_left(space, (lengths[i], -1))
        if at < len(space):
            free, b = space.pop(at)
        else:
            free, b, n = budget, n, n + 1
        out[i] = b
        if free - lengths[i] > 0:
            insort(space, (free - lengths[i], b))
    return out


def best_fit_shards(df: DataFrame, shard: str, order: str, length: str, budget: int, chunk: int = 1000) -> DataFrame:
    """(shard, order, length, pack): best-fit decreasing in chunks of `chunk` rows; a chunk's last, unfilled bin goes into the next."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        packs, carry, done = [-1] * len(pdf), [], 0
        n = pdf[length].tolist()
        for lo in range(0, len(pdf), chunk):
            items = carry + list(range(lo, min(lo + chunk, len(pdf))))
            bins = best_fit([n[i] for i in items], budget)
            last = max(bins, default=-1)
            final = lo + chunk >= len(pdf)
            carry = [] if final else [i for i, b in zip(items, bins, strict=True) if b == last]
            for i, b in zip(items, bins, strict=True):
                packs[i] = done + b
            done += last + 1 if final else last
        pdf["pack"] = packs
        return pdf

    own = df.select(F.col(shard).cast("long").alias(shard), F.col(order).cast("long").alias(order), F.col(length).cast("long").alias(length))
    return own.groupBy(shard).applyInPandas(run, f"{shard} long, {order} long, {length} long, pack long")


def packed_rows(df: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """One row a pack: members in order, total length, and position ids that restart with each member."""
    m = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(length).cast("int").alias("n"))))
    lengths = F.transform("m", lambda x: x["n"])
    return df.groupBy(*keys).agg(m.alias("m")).select(*keys, F.transform("m", lambda x: x["o"]).alias("members"), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), lengths.alias("lengths"))


def greedy_drop(sizes: list[int], target: int) -> list[bool]:
    """Which groups to drop, in order: one is dropped iff that brings the total nearer to the target."""
    total, out = sum(sizes), []
    for n in sizes:
        drop = abs(total - n - target) < abs(total - target)
        out.append(drop)
        total -= n if drop else 0
    return out


def rebalance(df: DataFrame, shard: str, order: str, size: str, target: int) -> DataFrame:
    """(shard, order, size) of the groups that stay after deletion-greedy rebalancing within each shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        return pdf[[not x for x in greedy_drop(pdf[size].tolist(), target)]]

    own = df.select(F.col(shard).cast("long").alias(shard), F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size))
    return own.groupBy(shard).applyInPandas(run, f"{shard} long, {order} long, {size} long")


def length_batches(df: DataFrame, key: str, length: str, batch: int, mega: int, seed: int = 42) -> DataFrame:
    """df with `mega`, `batch`: rows in hash order are dealt to megabatches of batch * mega rows and sorted by length there."""
    from pyspark.sql import Window as W

    from .sampling import hash_order, spread_rank

    ranked = spread_rank(df.withColumn("_h", hash_order(seed, "length", F.col(key))), [], "_h", [key], "_r")
    big = ranked.withColumn("mega", F.floor((F.col("_r") - 1) / (batch * mega)))
    w = W.partitionBy("mega").orderBy(F.desc(length), key)
    return big.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch)).drop("_h", "_r")


def stream_packs(batches: Iterator[list[tuple[int, int]]], budget: int) -> Iterator[list[list[int]]]:
    """Packs of each micro-batch of (id, length); the last unfilled bin joins the next batch and is flushed at the end (L3)."""
    carry: list[tuple[int, int]] = []
    for rows in batches:
        items = carry + rows
        bins = best_fit([n for _, n in items], budget)
        last = max(bins, default=-1)
        packs: list[list[int]] = [[] for _ in range(last)]
        carry = []
        for item, b in zip(items, bins, strict=True):
            if b == last:
                carry.append(item)
            else:
                packs[b].append(item[0])
        yield packs
    if carry:
        yield [[i for i, _ in carry]]
