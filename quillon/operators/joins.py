"""Joins of dataset building: provenance, leakage, overlaps, Hamming radius, components, routing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def last_write(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last by `order`: partial aggregation before the shuffle, no window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_s"))
    return picked.select(*keys, *[F.col("_s")[c].alias(c) for c in rest])


def chain_join(base: DataFrame, sides: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """base left-joined to each (name, side, keys) in turn; `missing` names the first side without a partner, null if all have one."""
    out = base
    for name, side, keys in sides:
        out = out.join(side.withColumn(f"_has_{name}", F.lit(True)), keys, "left")
    first = F.coalesce(*[F.when(F.col(f"_has_{name}").isNull(), F.lit(name)) for name, _, _ in sides])
    return out.withColumn("missing", first).drop(*[f"_has_{name}" for name, _, _ in sides])


def drift(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fields): the columns in which two versions of a row differ; null-safe."""
    both = left.alias("l").join(right.alias("r"), key)
    fields = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns]))
    return both.select(key, fields.alias("fields")).filter(F.size("fields") > 0)


def without_shared_tokens(train: DataFrame, test: DataFrame, key: str, tokens: str) -> DataFrame:
    """train rows that share no token with any test row; test rows are never touched (C4).

    Both sides are exploded to (key, token) and the test side reduced to distinct tokens, so a
    popular token is one row there.
    """
    seen = test.select(F.explode(tokens).alias("_t")).distinct()
    hit = train.select(key, F.explode(tokens).alias("_t")).join(seen, "_t", "left_semi").select(key).distinct()
    return train.join(hit, key, "left_anti")


def overlaps(df: DataFrame, value: str, side: str) -> DataFrame:
    """(value, n_sides, n_rows) of values that stand on more than one side."""
    return df.groupBy(value).agg(F.countDistinct(side).alias("n_sides"), F.count("*").alias("n_rows")).filter("n_sides > 1")


def hamming_pairs(df: DataFrame, key: str, high: str, low: str, radius: int, bits: int = 64) -> DataFrame:
    """(a, b, distance), a < b: rows whose hashes differ in at most `radius` bits.

    The hash is two unsigned 32-bit halves in longs. It is cut into radius + 1 chunks, of
    which one must be equal; a pair is kept only at its first equal chunk, so no distinct is needed.
    """
    m = radius + 1
    at = [i * bits // m for i in range(m + 1)]

    def chunk(h: Column, lo: Column, i: int) -> Column:
        value = F.lit(0).cast("long")
        for half, base in ((lo, 0), (h, 32)):
            a, b = max(at[i], base), min(at[i + 1], base + 32)
            if a < b:
                value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(half, a - base).bitwiseAND((1 << (b - a)) - 1), max(base - at[i], 0)))
        return value

    chunks = F.array(*[chunk(F.col(high), F.col(low), i) for i in range(m)])
    rows = df.select(F.col(key).alias("k"), F.col(high).alias("h"), F.col(low).alias("l"), chunks.alias("c"))
    dealt = rows.select("*", F.posexplode("c").alias("i", "v"))
    x, y = dealt.alias("x"), dealt.alias("y")
    distance = F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h"))) + F.bit_count(F.col("x.l").bitwiseXOR(F.col("y.l")))
    first = F.array_position(F.zip_with("x.c", "y.c", lambda p, q: p == q), True) - 1
    match = (F.col("x.i") == F.col("y.i")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.k") < F.col("y.k")) & (distance <= radius) & (first == F.col("x.i"))
    return x.join(y, match).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), distance.cast("long").alias("distance"))


#: A key is hot if it has more than 1 / HOT_KEYS of all rows, and over HOT_ROWS: so there are fewer than HOT_KEYS hot keys in any table.
HOT_KEYS, HOT_ROWS = 4096, 256


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with the one row of per_key that each key has; per_key's column n says how many rows of `rows` have the key.

    The rows of hot keys meet theirs by a broadcast of fewer than HOT_KEYS rows, the others by a shuffle in which no key has more than
    a 1 / HOT_KEYS share. Both tables are read several times, so they should be checkpoints. n is dropped.
    """
    total, most = per_key.agg(F.sum(n), F.max(n)).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= bound:
        return rows.join(per_key.drop(n), key)
    hot = F.broadcast(per_key.filter(F.col(n) > bound).drop(n))
    rest = rows.join(hot, key, "left_anti").join(per_key.filter(F.col(n) <= bound).drop(n), key)
    return rows.join(hot, key).unionByName(rest)


#: Graphs of up to so many links are solved by one task, whose work is bounded by that.
FEW_LINKS = 16_384


def _few_components(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph of few edges (u, v), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])

    return edges.repartition(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, a: str, b: str, rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """Connected components of long-valued edges: (node, root), root the smallest node.

    Large-star and small-star steps in turn (Kiveris and others, 2014) until
    nothing changes. Self-links are allowed. Each round is cut by checkpoints; a
    centre of very many links is dealt out, as hot keys are. Up to `few` links are
    solved in one task.
    """
    u, v = F.col("u"), F.col("v")
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(u.isNotNull() & (u != v)).distinct())
    if e.limit(few + 1).count() <= few:
        return _few_components(e)
    nodes = e.select(u.alias("node")).union(e.select(v.alias("node"))).distinct()
    mark = None
    for _ in range(rounds):
        both = e.union(e.select(v.alias("u"), u.alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = spread_join(both, low, "u", "n").filter(v > u).select(v.alias("u"), F.col("m").alias("v"))
        large = cut(large.filter(F.col("u") != F.col("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, low, "u", "n").select(v.alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def merged_components(roots: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): components found earlier (node, root), joined by further links; only the components that links touch are looked at again."""
    at = lambda end: roots.select(F.col("node").alias(f"_{end}"), F.col("root").alias(f"_r{end}"))
    own = links.select(F.col(a).alias("_x"), F.col(b).alias("_y")).join(at("x"), "_x", "left").join(at("y"), "_y", "left")
    joined = cut(components(own.select(F.coalesce("_rx", "_x").alias("x"), F.coalesce("_ry", "_y").alias("y")), "x", "y"))
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    known = roots.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return known.unionByName(joined.join(roots, "node", "left_anti"))


def token_components(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, component): rows joined by shared tokens. Each row links to its token's smallest row: rows - 1 links a token."""
    flat = rows.select(F.col(key).alias("k"), F.explode(tokens).alias("t"))
    flat = cut(flat)
    hubs = cut(flat.groupBy("t").agg(F.min("k").alias("hub"), F.count("*").alias("n")))
    linked = components(spread_join(flat, hubs, "t", "n").select("k", "hub"), "k", "hub").select(F.col("node").alias(key), "root")
    return rows.select(key).join(linked, key, "left").select(key, F.coalesce("root", key).alias("component"))


def route(rows: DataFrame, tag: str, workers: list[str]) -> DataFrame:
    """rows with `worker`: everything to a single worker, else the one of the row's tag; an unknown tag fails (C14)."""
    if len(workers) == 1:
        return rows.withColumn("worker", F.lit(workers[0]))
    ok = F.col(tag).isin(*workers)
    return rows.withColumn("worker", F.when(ok, F.col(tag)).otherwise(F.raise_error(F.concat(F.lit("no worker for tag "), F.coalesce(F.col(tag), F.lit("null"))))))


def gap(df: DataFrame, keys: list[str], side: str, value: str, first: str, second: str) -> DataFrame:
    """(keys, gap): value of one side less that of the other where both exist."""
    pick = lambda s: F.max(F.when(F.col(side) == s, F.col(value)))
    return df.groupBy(*keys).agg(pick(first).alias("_a"), pick(second).alias("_b")).filter("_a is not null and _b is not null").select(*keys, (F.col("_a") - F.col("_b")).alias("gap"))


def first_of_each(df: DataFrame, value: str, order: str) -> DataFrame:
    """The first row (by order) of each value, and how many later ones there were."""
    return df.groupBy(value).agg(F.min(order).alias(order), (F.count("*") - 1).alias("n_later"))


def vocabulary(tokens: DataFrame, token: str, norm: str) -> DataFrame:
    """(norm, n, display): frequency and the most frequent spelling, ties to the smallest."""
    by_spelling = tokens.groupBy(norm, token).agg(F.count("*").alias("c"))
    best = F.min_by(token, F.struct(-F.col("c"), F.col(token)))
    return by_spelling.groupBy(norm).agg(F.sum("c").alias("n"), best.alias("display"))


def rank_ties(df: DataFrame, value: str, group: list[str] | None = None) -> Column:
    """Rank with ties averaged."""
    w = W.partitionBy(*(group or [])).orderBy(value)
    same = W.partitionBy(*(group or []), value)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0


def intersection(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The distinct keys that stand in both (G3); nulls are equal."""
    return a.select(*on).intersect(b.select(*on))


def difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The distinct keys of a that b lacks (G3); nulls are equal."""
    return a.select(*on).subtract(b.select(*on))


def with_replay(current: DataFrame, replay: DataFrame, keys: list[str]) -> DataFrame:
    """current and replay rows with `origin` (G4); a key that stands in both is an error. Columns one side lacks are null."""
    shared = intersection(current, replay, keys).limit(1).collect()
    if shared:
        raise ValueError(f"a row stands in both tables: {shared[0].asDict()}")
    return current.withColumn("origin", F.lit("current")).unionByName(replay.withColumn("origin", F.lit("replay")), allowMissingColumns=True)


def deletion_proof(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (G5): rows before and after, how many went, how many of the rows after weren't there before as often; `holds` if none."""
    foreign = after.select(*before.columns).exceptAll(before).count()
    n, m = before.count(), after.count()
    return before.sparkSession.createDataFrame([(n, m, n - m, foreign, foreign == 0)], "n_before long, n_after long, n_removed long, n_foreign long, holds boolean")
