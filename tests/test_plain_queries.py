"""Registered queries that SQL can't express, against plain Python over the same tables."""

import collections
import itertools
import math

import duckdb
import pytest

from quillon import registry

SF = "/root/testdata/sf0.001"


def rows(sql):
    return duckdb.sql(sql.replace("@", SF)).fetchall()


def got(spark, name):
    return [r.asDict() for r in registry.queries()[name](spark, SF).collect()]


def lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, line[j + 1] = line[j + 1], last + 1 if x == y else max(line[j + 1], line[j])
    return line[-1]


def overlap(a, b, n):
    x, y = (collections.Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
    return sum((x & y).values()), sum(x.values()), sum(y.values())


def test_rouge_and_bleu(spark):
    mine = {r["doc_id"]: r for r in got(spark, "doc_rouge")}
    seen = 0
    for i, text in rows("select doc_id, text from '@/documents.parquet'"):
        a, b = text[: len(text) // 2].lower().split(), text[len(text) // 2 :].lower().split()
        if len(a) * len(b) > 60_000:
            continue
        seen += 1
        r = mine[i]
        if not a or not b:
            assert r["rouge_l"] == 0 and r["rouge1"] is None
            continue
        assert r["rouge_l"] == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)), abs=1e-6)
        for n, name in ((1, "rouge1"), (2, "rouge2")):
            hit, x, y = overlap(a, b, n)
            assert r[name] == pytest.approx(200 * hit / (x + y) if x + y else 0.0, abs=1e-5)
        log, halved = 0.0, 1
        for n in range(1, 5):
            hit, _, y = overlap(a, b, n)
            if not hit:
                halved *= 2
            log += math.log(hit / max(1, y) if hit else 1 / (halved * max(1, y)))
        assert r["bleu4"] == pytest.approx(100 * math.exp(log / 4) * min(1.0, math.exp(1 - len(a) / len(b))), abs=1e-5)
    assert seen > 100


def iou(a, b):
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def test_box_matching_by_trying_all_assignments(spark):
    orders = collections.defaultdict(lambda: ([], []))
    for key, quantity, *box in rows("select l_orderkey, l_quantity, (l_suppkey % 20)::double, (l_partkey % 20)::double, l_suppkey % 20 + l_quantity % 13 + 1, (l_partkey % 20 + l_linenumber + 3)::double from '@/lineitem.parquet'"):
        orders[key][int(quantity > 25)].append(box)
    mine = {r["l_orderkey"]: r for r in got(spark, "box_matching")}
    assert mine.keys() == orders.keys()
    for key, (p, r) in orders.items():
        p.sort()
        r.sort()
        best = (0.0, ())
        few, many = (p, r) if len(p) <= len(r) else (r, p)
        for chosen in itertools.permutations(range(len(many)), len(few)) if p and r else ():
            values = [iou(few[i], many[j]) for i, j in enumerate(chosen)]
            best = max(best, (sum(values), values), key=lambda x: x[0])
        assert mine[key]["optimal"] == pytest.approx(best[0] / len(r) if r else 0.0, abs=2e-6)
        left, right, total = set(range(len(p))), set(range(len(r))), 0.0
        while left and right:
            v, i, j = max(((iou(p[i], r[j]), -i, -j) for i in left for j in right))
            total += v
            left.discard(-i)
            right.discard(-j)
        assert mine[key]["greedy"] == pytest.approx(total / len(r) if r else 0.0, abs=2e-6)


def best_fit(items, budget):
    """Bins by looking at every open bin: the fullest that an item fits."""
    bins, place = [], {}
    for n, i in sorted(items, key=lambda x: (-x[0], x[1])):
        open_ = [(budget - used, b) for b, used in enumerate(bins) if 0 < budget - used and used + n <= budget]
        if open_:
            b = min(open_)[1]
        else:
            b = len(bins)
            bins.append(0)
        bins[b] += n
        place[i] = b
    return place, bins


def test_best_fit_packs(spark):
    sizes = collections.defaultdict(dict)
    for i, n in rows("select doc_id, ceil(n_chars / 4.0)::bigint from '@/documents.parquet'"):
        sizes[i // 500][i] = n
    mine = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in got(spark, "doc_pack_bfd"):
        mine[r["shard"]][r["pack"]].append((r["doc_id"], r["len"]))
    for shard, lengths in sizes.items():
        order = sorted(lengths)
        packs, carry = [], []
        for lo in range(0, len(order), 50):
            items = carry + order[lo : lo + 50]
            place, bins = best_fit([(lengths[i], k) for k, i in enumerate(items)], 2048)
            each = [[items[k] for k in range(len(items)) if place[k] == b] for b in range(len(bins))]
            carry = each.pop() if lo + 50 < len(order) else []
            packs += each
        want = collections.Counter(frozenset(p) for p in packs)
        assert collections.Counter(frozenset(i for i, _ in p) for p in mine[shard].values()) == want


def test_streamed_packs_hold_every_row_once_within_the_budget(spark):
    sizes = dict(rows("select doc_id, ceil(n_chars / 4.0)::bigint from '@/documents.parquet'"))
    packs = collections.defaultdict(list)
    for r in got(spark, "stream_pack_carry"):
        packs[r["shard"], r["pack"]].append(r["member"])
        assert r["length"] == sizes[r["member"]] and r["shard"] == r["member"] % 4
    assert sorted(i for p in packs.values() for i in p) == sorted(sizes)
    assert all(len(p) == 1 or sum(sizes[i] for i in p) <= 2048 for p in packs.values())


def test_image_hash_and_similarity(spark):
    vectors = dict(rows("select vec_id, embedding::double[] from '@/embeddings.parquet' where vec_id < 12"))
    mine = {r["vec_id"]: r for r in got(spark, "emb_image_hash")}
    cos = [[math.cos(math.pi * (2 * x + 1) * k / 64) * math.sqrt((1 if k == 0 else 2) / 32) for x in range(32)] for k in range(8)]
    for i, v in vectors.items():
        p = [x * 100 + 128 for x in v] * 16
        half = [[sum(cos[k][y] * p[32 * y + x] for y in range(32)) for x in range(32)] for k in range(8)]
        low = [sum(half[k][x] * cos[m][x] for x in range(32)) for k in range(8) for m in range(8)]
        rest = sorted(low[1:])
        sure = [abs(x - rest[31]) > 1e-6 for x in low]
        bits = f"{int(mine[i]['phash'], 16):064b}"
        assert all((b == "1") == (x > rest[31]) for b, x, s in zip(bits, low, sure, strict=True) if s) and sum(sure) > 1
        q, n = p[::-1], len(p)
        mp, mq = sum(p) / n, sum(q) / n
        cov = lambda a, b, ma, mb: sum(x * y for x, y in zip(a, b, strict=True)) / n - ma * mb
        want = (2 * mp * mq + 6.5025) * (2 * cov(p, q, mp, mq) + 58.5225) / ((mp * mp + mq * mq + 6.5025) * (cov(p, p, mp, mp) + cov(q, q, mq, mq) + 58.5225))
        assert mine[i]["similarity"] == pytest.approx(want, abs=2e-6)
