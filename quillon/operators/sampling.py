"""Deterministic sampling: hash orders, ranks without single-task windows, quotas, splits, selections.

Randomness is always the order of sha256("seed|purpose|id"), so a sample is the
same on every cluster and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import ROWS_PER_PART, ranked


def hash_order(seed: int | str, purpose: str, *keys: Column) -> Column:
    """The hex digest that rows are ordered by."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in keys]), 256)


def digits_for(rows: int, rows_per_part: int = ROWS_PER_PART) -> int:
    """Hex digits of a digest that part so many rows into parts of at most rows_per_part on average; two at least."""
    d = 2
    while rows > rows_per_part << 4 * d:
        d += 1
    return d


def spread_rank(df: DataFrame, group: list[str], digest: str, ties: list[str], name: str = "rank", digits: int | None = None) -> DataFrame:
    """Rank (from 1) by digest within each group, dealt over 16**digits parts a group; by default as many as the rows need.

    A group's rows are ranked within the digest's first digits, and the counts of
    the lower prefixes are added: a group with a third of all rows is no hot task.
    """
    digits = digits_for(df.count()) if digits is None else digits
    return _dealt_rank(df, group, F.substring(digest, 1, digits), [digest, *ties], name)


def _dealt_rank(df: DataFrame, group: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """Rank (from 1) in each group by an order that `bucket` follows: ranks within buckets, and the counts of the earlier ones added."""
    own = df.withColumn("_b", bucket)
    counts = own.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    ranked = own.withColumn("_r", F.row_number().over(W.partitionBy(*group, "_b").orderBy(*order)))
    match = F.col("_b").eqNullSafe(F.col("_c"))
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return ranked.join(offsets, match).select(*df.columns, (F.col("_r") + F.col("_o")).cast("long").alias(name))


def value_rank(df: DataFrame, group: list[str], values: list[tuple[str, bool]], digest: str, ties: list[str], name: str = "rank", cuts: int = 64) -> DataFrame:
    """Rank (from 1) by numbers, each rising or falling (True), then by digest, dealt over ranges of the numbers.

    Ranges end at approximate quantiles. A number that is a quantile has a range of its own, which the next number parts
    further, and after the last one the digest's first digits: so neither a large group nor a frequent number is one task.
    Null numbers come last.
    """
    parts: list[Column] = []
    open_ = F.lit(True)  # all numbers so far stand alone in their range
    points = df.approxQuantile([v for v, _ in values], [i / cuts for i in range(1, cuts)], 0.002)
    for (v, falling), at in zip(values, points, strict=True):
        ends = F.array(*[F.lit(float(x)) for x in sorted(set(at))]).cast("array<double>")
        x = F.col(v).cast("double")
        place = 2 * F.size(F.filter(ends, lambda e: e < x)) + F.array_contains(ends, x).cast("int")
        parts.append(F.when(open_, F.coalesce(-place if falling else place, F.lit(1 << 30))))
        open_ = open_ & F.coalesce(F.array_contains(ends, x), F.lit(False))
    parts.append(F.when(open_, F.substring(digest, 1, 2)))
    order = [F.desc_nulls_last(v) if falling else F.asc_nulls_last(v) for v, falling in values]
    return _dealt_rank(df, group, F.struct(*parts), [*order, digest, *ties], name)


def number_rank(df: DataFrame, key: str, name: str = "rank", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Global rank (from 1) by a unique key, dealt over ranges of about equally many rows, however the keys are spread."""
    return ranked(df, [], [key], name, rows_per_part)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows: whole copies as often as they fit, the rest by hash order; `copy` numbers the copies (F1)."""
    total = df.count()
    if total == 0:
        return df.withColumn("copy", F.lit(0).cast("long"))
    times, rest = divmod(n, total)
    ranked = spread_rank(df.withColumn("_h", hash_order(seed, "sample", F.col(key))), [], "_h", [key], "_rank")
    copies = F.when(F.col("_rank") <= rest, times + 1).otherwise(times)
    return ranked.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("copy", F.col("copy").cast("long")).drop("_rank", "_h")


def train_val_split(df: DataFrame, key: str, ratio: float, sample: int | None = None, seed: int = 42) -> DataFrame:
    """df with `split`: max(int(min(rows, sample) * ratio), 1) rows by hash order are `val` (F2)."""
    total = df.count()
    val = 0 if ratio == 0 else total if ratio == 1 else max(int(min(total, sample or total) * ratio), 1)
    ranked = spread_rank(df.withColumn("_h", hash_order(seed, "split", F.col(key))), [], "_h", [key], "_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") <= val, "val").otherwise("train")).drop("_rank", "_h")


def proportional_quota(counts: DataFrame, key: str, n: str, total: int, descending_keys: bool = False) -> DataFrame:
    """counts with `quota`: floor(total * n / N), the largest integer remainders get one more."""
    all_n = F.sum(n).over(W.partitionBy())
    own = counts.withColumn("_all", all_n).withColumn("_q", F.floor(F.lit(total) * F.col(n) / F.col("_all"))).withColumn("_m", (F.lit(total) * F.col(n)) % F.col("_all"))
    order = W.orderBy(F.desc("_m"), F.desc(key) if descending_keys else F.asc(key))
    left = F.lit(total) - F.sum("_q").over(W.partitionBy())
    return own.withColumn("quota", (F.col("_q") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).cast("long")).drop("_all", "_q", "_m")


def waterfill_quota(counts: DataFrame, key: str, n: str, total: int, seed: int = 42) -> DataFrame:
    """counts with `quota`: full below the level, the level above it, the rest by hash of the key."""
    w = W.orderBy(n, key)
    own = counts.withColumn("_i", F.row_number().over(w)).withColumn("_k", F.count("*").over(W.partitionBy())).withColumn("_p", F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("_l", (F.lit(total) - F.col("_p")) / (F.col("_k") - F.col("_i") + 1))
    level = F.min(F.when(F.col(n) >= F.col("_l"), F.struct("_i", "_l"))).over(W.partitionBy())["_l"]
    own = own.withColumn("_level", level).withColumn("_q", F.when(F.col("_level").isNull() | (F.col(n) < F.col("_level")), F.col(n)).otherwise(F.floor("_level")))
    own = own.withColumn("_left", F.lit(total) - F.sum("_q").over(W.partitionBy())).withColumn("_open", F.col(n) >= F.col("_level")).withColumn("_h", hash_order(seed, "waterfill", F.col(key)))
    r = F.row_number().over(W.partitionBy("_open").orderBy("_h", key))
    return own.withColumn("quota", (F.col("_q") + F.when(F.col("_open") & (r <= F.col("_left")), 1).otherwise(0)).cast("long")).select(*counts.columns, "quota")


def apportion(counts: DataFrame, key: str, n: str, total: str | int, group: list[str] | None = None) -> DataFrame:
    """counts with `quota`: equal shares under capacity (F7): the integer level L with sum(min(n, L)) <= total, then one more
    for the first keys above it. `total` is a number, or a column that is constant in each group."""
    group = group or []
    t = F.col(total) if isinstance(total, str) else F.lit(total)
    w, all_ = W.partitionBy(*group).orderBy(n, key), W.partitionBy(*group)
    own = counts.withColumn("_t", t).withColumn("_i", F.row_number().over(w)).withColumn("_k", F.count("*").over(all_)).withColumn("_p", F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("_l", F.floor((F.col("_t") - F.col("_p")) / (F.col("_k") - F.col("_i") + 1)))
    first = F.min(F.when(F.col(n) > F.col("_l"), F.struct("_i", "_l"))).over(all_)["_l"]
    own = own.withColumn("_level", first).withColumn("_q", F.when(F.col("_level").isNull(), F.col(n)).otherwise(F.least(F.col(n), F.col("_level"))))
    own = own.withColumn("_left", F.col("_t") - F.sum("_q").over(all_)).withColumn("_open", F.coalesce(F.col(n) > F.col("_level"), F.lit(False)))
    r = F.row_number().over(W.partitionBy(*group, "_open").orderBy(key))
    return own.withColumn("quota", (F.col("_q") + F.when(F.col("_open") & (r <= F.col("_left")), 1).otherwise(0)).cast("long")).select(*counts.columns, "quota")


def take_quota(df: DataFrame, quotas: DataFrame, group: list[str], digest: str, ties: list[str]) -> DataFrame:
    """The first `quota` rows of each group by digest. quotas has a row a group (a small table)."""
    ranked = spread_rank(df, group, digest, ties, "_rank")
    return ranked.join(quotas.select(*group, "quota"), group).filter(F.col("_rank") <= F.col("quota")).drop("_rank", "quota")


def stratified_select(df: DataFrame, key: str, primary: str, secondary: str, total: int, seed: int = 42) -> DataFrame:
    """Equal shares over primary strata, then over secondary strata within each, by hash order (F8)."""
    cells = df.groupBy(primary, secondary).agg(F.count("*").alias("n"))
    tops = apportion(cells.groupBy(primary).agg(F.sum("n").alias("n")), primary, "n", total).select(primary, F.col("quota").alias("_top"))
    quotas = apportion(cells.join(tops, primary), secondary, "n", "_top", [primary])
    return take_quota(df.withColumn("_h", hash_order(seed, "stratified", F.col(key))), quotas, [primary, secondary], "_h", [key]).drop("_h")


def tiered_select(df: DataFrame, key: str, cell: str, score: str, hardness: str, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """Per cell 70% best by score, 20% by hash from the rest, the remainder hardest first; adds `tier`."""
    q = df.join(quotas.select(cell, "quota"), cell)
    high, mid = F.floor(F.col("quota") * 7 / 10), F.floor(F.col("quota") * 2 / 10)
    h = lambda p: hash_order(seed, p, F.col(key))
    a = value_rank(q.withColumn("_h", h("high")), [cell], [(score, True)], "_h", [key], "_r").withColumn("_hi", F.col("_r") <= high)
    b = spread_rank(a.withColumn("_h", h("diversity")), [cell, "_hi"], "_h", [key], "_r2").withColumn("_mid", ~F.col("_hi") & (F.col("_r2") <= mid))
    c = b.withColumn("_rest", ~F.col("_hi") & ~F.col("_mid")).withColumn("_h", h("hard"))
    c = value_rank(c, [cell, "_rest"], [(hardness, True), (score, False)], "_h", [key], "_r3").withColumn("_hard", F.col("_rest") & (F.col("_r3") <= F.col("quota") - high - mid))
    tier = F.when(F.col("_hi"), "high").when(F.col("_mid"), "diversity").when(F.col("_hard"), "hard")
    return c.withColumn("tier", tier).filter("tier is not null").select(*df.columns, "tier")


def round_robin(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42, hashed_strata: bool = False) -> DataFrame:
    """n rows, one of each stratum in turn, strata in key (or hash) order."""
    ranked = spread_rank(df.withColumn("_h", hash_order(seed, "robin", F.col(key))), [stratum], "_h", [key], "round")
    order = hash_order(seed, "stratum", F.col(stratum)) if hashed_strata else F.col(stratum)
    return ranked.orderBy("round", order, key).limit(n).drop("_h")


def best_of_n(df: DataFrame, group: str, key: str, prm: Column, orm: Column, keep: int) -> DataFrame:
    """Per group: score = normalised prm + 10 * orm; the `keep` best are chosen against the worst, which is never chosen itself."""
    w = W.partitionBy(group)
    own = df.withColumn("_p", prm.cast("double")).withColumn("_lo", F.min("_p").over(w)).withColumn("_hi", F.max("_p").over(w))
    flat = F.when(F.col("_lo") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("_lo")))
    norm = F.when(F.col("_lo") == F.col("_hi"), flat).otherwise((F.col("_p") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-5))
    own = own.withColumn("score", norm + orm.cast("double") * 10)
    own = own.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), key)).cast("long")).withColumn("_n", F.count("*").over(w)).withColumn("rejected", F.last(key).over(w.orderBy(F.desc("score"), key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return own.filter((F.col("place") <= keep) & (F.col("place") < F.col("_n"))).select(group, key, "score", "place", "rejected")


def interleave(a: DataFrame, b: DataFrame, key: str, share: float, stop: str = "first_exhausted") -> DataFrame:
    """A weighted merge: row i of a (share p) is due at i/p, of b at i/(1-p); `place` numbers the merged rows.

    `first_exhausted` ends with the shorter stream; `all_exhausted` takes all rows.
    """
    due = lambda df, p, src: number_rank(df, key, "_i").select("*", (F.col("_i") / p).alias("_due"), F.lit(src).alias("origin"))
    both = due(a, share, "a").unionByName(due(b, 1 - share, "b"))
    if stop == "first_exhausted":
        ends = both.groupBy("origin").agg(F.max("_due").alias("_d")).agg(F.min("_d").alias("_end"))
        both = both.crossJoin(F.broadcast(ends)).filter(F.col("_due") <= F.col("_end")).drop("_end")  # one row
    return both.drop("_i")


def slice_of(df: DataFrame, key: str, i: int, n: int) -> DataFrame:
    """Piece i of n of floor(rows / n) rows in key order; the tail is dropped."""
    size = df.count() // n
    return number_rank(df, key, "_r").filter(F.col("_r").between(i * size + 1, (i + 1) * size)).drop("_r")


def shards(df: DataFrame, key: str, world: int) -> DataFrame:
    """df with `shard` = (rank - 1) mod world, without the last incomplete round."""
    whole = df.count() // world * world
    return number_rank(df, key, "_r").filter(F.col("_r") <= whole).withColumn("shard", ((F.col("_r") - 1) % world).cast("long")).drop("_r")


def prefix_fill(groups: DataFrame, order: list[str], size: str, target: int) -> DataFrame:
    """Whole groups in order while the sum before them is below target."""
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return groups.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long")).filter(F.col("before") < target)


#: Items and bytes of a pool that is broadcast.
SMALL_RING = (100_000, 8_000_000)


def negatives(rows: DataFrame, pool: DataFrame, row_key: str, answer: str, item: str, k: int, seed: int = 42) -> DataFrame:
    """k pool items per row that aren't among its own answers, `place` 1 to k.

    The distinct items of the whole pool stand in a ring in hash order; a row takes the k next ones from a place given by its own
    hash that aren't its answers. It looks at k items more than it has answers, so it finds k wherever the pool holds them, and
    meets no more of the pool than that. `answer` is a column of one answer or of a list.
    """
    ring = spread_rank(pool.select(item).filter(F.col(item).isNotNull()).distinct().withColumn("_h", hash_order(seed, "pool", F.col(item))), [], "_h", [item], "_at").drop("_h")
    n, held = ring.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(item).cast("string"))), F.lit(0))).first()
    listed = F.col(answer) if isinstance(rows.schema[answer].dataType, T.ArrayType) else F.array(answer)
    first = F.conv(F.substring(hash_order(seed, "negative", F.col(row_key)), 1, 12), 16, 10).cast("long") % max(n, 1)
    looks = F.least(F.lit(n), k + F.coalesce(F.size(listed), F.lit(0))).cast("int")
    own = rows.withColumn("_own", listed).withColumn("_j", F.explode(F.sequence(F.lit(1), looks)) if n else F.explode(F.array().cast("array<int>")))
    # Spark sees a file's size, not what rows come to once they are dealt out to their looks: the rows themselves are never broadcast
    side = F.broadcast(ring) if n <= SMALL_RING[0] and held <= SMALL_RING[1] else ring.hint("merge")
    met = own.withColumn("_at", (first + F.col("_j") - 1) % max(n, 1) + 1).join(side, "_at").filter(~F.coalesce(F.array_contains("_own", F.col(item)), F.lit(False)))
    place = F.row_number().over(W.partitionBy(row_key).orderBy("_j")).cast("long")
    return met.withColumn("place", place).filter(F.col("place") <= k).drop("_own", "_j", "_at")


def task_quotas(tasks: DataFrame, key: str, total: int) -> DataFrame:
    """(key, quota): total div tasks for each distinct task, one more for the first total mod tasks in key order (F13). A small table."""
    if total < 0:
        raise ValueError("the budget must not be negative")
    own = tasks.select(key).distinct()
    n = own.count()
    if n == 0:
        return own.withColumn("quota", F.lit(0).cast("long"))
    return number_tasks(own, key).withColumn("quota", (F.lit(total // n) + (F.col("_i") <= total % n).cast("int")).cast("long")).drop("_i")


def number_tasks(tasks: DataFrame, key: str) -> DataFrame:
    return tasks.withColumn("_i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(key)))
