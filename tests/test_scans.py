"""Dealt scans, halo windows and whole-order packing against plain Python, with groups larger than a range."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import attempts as A
from quillon.operators import packing as P
from quillon.operators import sampling as S
from quillon.operators import scans


def test_running_over_large_null_and_small_groups(spark):
    r = random.Random(1)
    rows = [("hot", i, r.randint(-5, 5)) for i in range(400)] + [(None, i, i) for i in range(50)] + [(f"g{i % 20}", i, None if i % 7 == 0 else i) for i in range(100)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    got = {(x.g, x.o): (x.s, x.n) for x in scans.running(d, ["g"], ["o"], {"s": F.col("v"), "n": F.lit(1)}, rows_per_part=16).collect()}
    assert len(got) == len(rows)
    for g in {x[0] for x in rows}:
        total = 0
        for n, (_, o, v) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1]), 1):
            total += v or 0
            assert got[g, o] == (total, n)
    assert scans.running(d.limit(0), ["g"], ["o"], {"s": F.col("v")}).count() == 0


def test_parts_are_many_for_one_group(spark):
    d = spark.range(1000).withColumn("g", F.lit(1))
    sizes = [x["count"] for x in scans.parts(d, ["g"], ["id"], 50).groupBy("_part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 200


def test_rank_with_an_outlying_key(spark):
    keys = [*range(500), 10**15, -(10**15)]
    d = spark.createDataFrame([(k,) for k in keys], "k long")
    assert {x.k: x["rank"] for x in S.number_rank(d, "k", rows_per_part=50).collect()} == {k: i for i, k in enumerate(sorted(keys), 1)}
    biggest = max(x["count"] for x in scans.parts(d, [], ["k"], 50).groupBy("_part").count().collect())
    assert biggest < 150


def test_digits_follow_the_rows():
    assert [S.digits_for(n) for n in (0, 10**6, 256 * 10**6, 256 * 10**6 + 1, 10**11)] == [2, 2, 2, 3, 5]


def test_smoothed_values_and_their_end(spark):
    r = random.Random(2)
    rows = [(i % 2 if i > 30 else 0, i, None if i % 11 == 0 else r.uniform(-3, 3)) for i in range(300)]
    d = spark.createDataFrame(rows, "g int, o long, v double").repartition(3)
    for smooth in (0.9, 0.999, 0.0):
        got = {(x.g, x.o): x.ema for x in A.smoothed(d, ["g"], ["o"], "v", smooth, rows_per_part=20).collect()}
        for g in (0, 1):
            x = w = 0.0
            for _, o, v in sorted(t for t in rows if t[0] == g):
                x, w = x * smooth + (v or 0), w * smooth + 1
                assert got[g, o] == pytest.approx(x / w)
        ends = {x.g: x.ema for x in A.debiased_ema(d, "g", "o", "v", smooth, rows_per_part=20).collect()}
        for g in (0, 1):
            x = w = 0.0
            for _, _, v in sorted((t for t in rows if t[0] == g and t[2] is not None), key=lambda t: t[1]):
                x, w = x * smooth + v, w * smooth + 1
            assert ends[g] == pytest.approx(x / w)


def test_bursts_see_rows_before_their_block(spark):
    r = random.Random(3)
    rows = [(0 if i % 10 else 1, i, r.random() < 0.25, r.randint(0, 5)) for i in range(600)]
    d = spark.createDataFrame(rows, "g int, o long, hit boolean, who int").withColumn("ts", F.timestamp_seconds(F.col("o") * 40))
    got = {x.o: x.burst for x in A.bursts(d, ["g"], ["o"], "hit", "who", "ts", rows_per_part=64, block=40).collect()}
    for g in (0, 1):
        own = sorted(x for x in rows if x[0] == g)
        for i, (_, o, hit, _) in enumerate(own):
            last = own[max(0, i - 19) : i + 1]
            ids = {x[3] for x in last if x[2] and (o - x[1]) * 40 <= 300}
            want = "three_in_a_row" if i > 1 and all(x[2] for x in own[i - 2 : i + 1]) else "five_in_recent" if sum(x[2] for x in last) >= 5 else "several_ids" if len(ids) >= 3 else None
            assert got[o] == want


def test_sessions_and_budget_of_one_key(spark):
    d = spark.range(300).select(F.lit("one").alias("k"), "id", (F.col("id") % 50 == 10).alias("start"), (F.col("id") % 3).cast("double").alias("cost"))
    s = {x.id: x.session for x in A.sessions(d, ["k"], ["id"], F.col("start"), rows_per_part=30).collect()}
    assert all(s[i] == sum(1 for j in range(i + 1) if j % 50 == 10) for i in range(300))
    b = {x.id: (x.spent, x.allowed) for x in A.budget(d, ["k"], ["id"], F.col("cost"), 100.0, rows_per_part=30).collect()}
    total = 0.0
    for i in range(300):
        total += i % 3
        assert b[i] == (total, 100.0 - total > 0)


def plain_packs(lengths, budget):
    out, pack, used, any_ = [], 0, 0, False
    for n in lengths:
        if any_ and used + n > budget:
            pack, used, any_ = pack + 1, 0, False
        out.append(pack)
        used, any_ = used + n, True
        if used >= budget:
            pack, used, any_ = pack + 1, 0, False
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_next_fit_over_one_order(spark, seed):
    r = random.Random(seed)
    lengths = [r.choice([0, 0, 0, 1, 2, 3, 5, 9, 10, 11, 45, 300] if seed > 1 else [1, 2, 3, 4]) for _ in range(700)]
    d = spark.createDataFrame([(i * 3, None if n == 0 and i % 2 else n) for i, n in enumerate(lengths)], "i long, n long").repartition(4)
    got = [x.pack for x in P.next_fit_order(d, ["i"], "n", 10, packs_per_part=2, rows_per_part=60).orderBy("i").collect()]
    assert got == plain_packs(lengths, 10)


def test_next_fit_of_nothing_and_of_empties(spark):
    d = spark.createDataFrame([], "i long, n long")
    assert P.next_fit_order(d, ["i"], "n", 10).count() == 0
    d = spark.range(20).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("n"))
    assert {x.pack for x in P.next_fit_order(d, ["i"], "n", 10).collect()} == {0}


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_by_rounds_and_in_one_task(spark, few):
    from quillon.operators import joins

    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in joins.components(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b", few=few).collect()}
    assert got == {x: root(x) for x in {n for a, b in edges if a != b for n in (a, b)}}


def test_components_merge_by_further_links(spark):
    from quillon.operators import joins

    first = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")
    more = spark.createDataFrame([(2, 4), (9, 8), (7, 6), (9, 9)], "a long, b long")
    roots = joins.components(first, "a", "b")
    got = {x.node: x.root for x in joins.merged_components(roots, more, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 8, 9: 8}
    assert {x.node: x.root for x in joins.merged_components(roots, more.limit(0), "a", "b").collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
