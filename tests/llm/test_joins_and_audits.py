"""The Jaccard join, hard negatives and the source audit against plain Python."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import divergence, jaccard, mining

from .conftest import plain, rows

WS, TERM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


# ---- Jaccard join


def shingles(text, k=5):
    w = re.findall(WS, low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def linked(table, num=80, den=100):
    """(doc_id, size, component) of each row, by trying all pairs."""
    sets = [shingles(t) for _, t in table]
    up = list(range(len(table)))

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(table):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return collections.Counter((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(table, sets, strict=True)))


def found(df):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in plain(df))


def test_jaccard_of_awkward_rows(spark, docs, empty):
    assert found(jaccard.join(docs)) == linked([(r[0], r[1]) for r in rows()])
    assert jaccard.join(empty).count() == 0


def near_copies(seed, groups=12):
    """Groups of texts that differ in so many words that many pairs lie near the bound; a passage that a third of all texts share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    shared = [word() for _ in range(40)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([3, 5, 8, 12, 30, 90, 200]))]
        if g % 3 == 0:
            base = base + shared
        for _ in range(r.choice([1, 2, 6, 14])):
            t = list(base)
            for _ in range(r.randrange(0, 1 + len(t) // 25 + 1)):
                at = r.randrange(len(t))
                t[at : at + r.choice([0, 1, 2])] = [word()] if r.random() < 0.7 else []
            out.append(" ".join(t))
    r.shuffle(out)
    ids = list(range(len(out)))
    r.shuffle(ids)
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize(("seed", "block", "turns"), [(1, 1024, 2), (2, 4, 1), (3, 3, 0)])
def test_jaccard_near_the_bound(spark, seed, block, turns):
    table = near_copies(seed)
    d = spark.createDataFrame([(*x, 1) for x in table], "doc_id long, text string, node int").repartition(5)
    assert found(jaccard.join(d, range_entries=300, block=block, turns=turns)) == linked(table)


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(7)
    for size in [1, 2, 3, 4, 5, 6, 7, 9, 12, 16, 25, 40, 80, 150, 400, 1500]:
        for _ in range(60 if size < 100 else 8):
            a = r.integers(0, 1 << 63, size, dtype=np.uint64)
            keep = math.ceil(len(a) * 0.8) if r.random() < 0.5 else size
            extra = int(keep / 0.8) - size if keep == size else 0
            b = np.concatenate([a[:keep], r.integers(0, 1 << 63, int(r.integers(0, extra + 1)), dtype=np.uint64)])
            sets = [np.unique(a), np.unique(b)]
            both = len(np.intersect1d(*sets))
            if 100 * both < 80 * (len(sets[0]) + len(sets[1]) - both):
                continue
            doc, h = np.repeat([0, 1], [len(x) for x in sets]), np.concatenate(sets)
            owner, sig = jaccard.signatures(doc, h, 2, 80, 100)
            assert np.intersect1d(sig[owner == 0], sig[owner == 1]).size, (size, len(sets[1]))


def test_large_group_of_copies_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(60))
    table = [(i + 10, text) for i in range(600)] + [(None, text), (3, text + " more"), (None, "only here"), (5, "only  HERE"), (6, None), (6, ""), (7, " ")]
    d = spark.createDataFrame(table, "doc_id long, text string").repartition(7)
    assert found(jaccard.join(d)) == linked(table)


# ---- hard negatives


def test_strassen_is_exact():
    r = np.random.default_rng(3)
    for m, k, n in [(1, 1, 1), (17, 18, 19), (40, 64, 33), (65, 7, 90), (3, 50, 70), (0, 5, 4), (37, 41, 1)]:
        a, b = r.integers(-(1 << 24), 1 << 24, (m, k)), r.integers(-(1 << 24), 1 << 24, (k, n))
        assert np.array_equal(mining.strassen(a, b, leaf=2), a @ b)


def hard(table):
    """All results by trying every pair of rows."""
    own = []
    for i, v, y in table:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for p, (i, v, y) in enumerate(own):
        if i is None or i % 100:
            continue
        all_ = [(score(v, w), j, z) for q, (j, w, z) in enumerate(own) if q != p]
        for ps, pi, _ in sorted((x for x in all_ if x[2] == y), key=order)[:5]:
            near = sorted((x for x in all_ if x[2] != y and 30 * ps <= 100 * x[0] <= 90 * ps), key=order)[:10]
            out += [(i, pi, k, ni, ps, ns) for k, (ns, ni, _) in enumerate(near, 1)]
    return collections.Counter(out)


def mined(spark, table, **kw):
    d = spark.createDataFrame([(*x, 0) for x in table], "vec_id long, embedding array<float>, label int, tile int").repartition(3)
    label = F.when(d["vec_id"] % 7 == 0, (d["label"].cast("long") + 1) % 10).otherwise(d["label"])
    got = plain(mining.mine(d, anchors=d["vec_id"] % 100 == 0, label=label, **kw))
    return collections.Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got)


def vectors(n, seed, dims=6):
    r = random.Random(seed)
    out = [(i * 5, [r.choice([-0.5, 0.25, 0.5, r.uniform(-1, 1)]) for _ in range(dims)], r.randrange(3)) for i in range(n)]
    return out


@pytest.mark.parametrize(("tile", "panel"), [(1024, 8192), (7, 3)])
def test_hard_negatives(spark, tile, panel):
    odd = [
        (100, None, 1), (200, [0.5, None], 1), (300, [0.5, float("nan")], 1), (400, [float("inf")], 1), (500, [0.5] * 6, None), (None, [0.5] * 6, 1), (None, [0.5] * 6, 2), (600, [], 1), (700, [0.5, 0.5], 1), (0, [0.5] * 6, 1), (0, [0.5] * 6, 1),
        (9, [0.5] * 9, 2), (-700, [0.25] * 6, 9), (7, [0.25] * 6, 9), *[(40, [0.5] * 6, 2)] * 12,
    ]
    table = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in vectors(150, 5) + odd]
    assert mined(spark, table, tile_rows=tile, panel_rows=panel) == hard(table)


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, []) == mined(spark, [(3, [1.0], 1)]) == mined(spark, [(100, [1.0], 1)]) == collections.Counter()
    with pytest.raises(ValueError, match="too long"):
        mined(spark, [(100, [1e30], 1), (1, [1.0], 1)])


# ---- divergence


def audited(table, least, top):
    """Every value from whole counts, in Python's integers."""
    occ, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in table:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(TERM, low(text))
        occ.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    kept = collections.defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)
    share = lambda c, n, v: 1 + 1_000_000_000 * (c + 5) // (n + 5 * v)
    out = []
    for lang, source in groups:
        v, of = len(kept[lang]), [s for g, s in groups if g == lang]
        n = {s: sum(occ[lang, s, t] for t in kept[lang]) for s in of}
        p = {s: {t: share(occ[lang, s, t], n[s], v) for t in kept[lang]} for s in of}
        whole = {t: sum(occ[lang, s, t] for s in of) for t in kept[lang]}
        q = {t: share(c, sum(whole.values()), v) for t, c in whole.items()}
        pairs = [(sum(abs(p[source][t] - p[s][t]) for t in kept[lang]), s) for s in of if s != source]
        terms = [(p[source][t] - q[t], t) for t in kept[lang] if occ[lang, source, t] and p[source][t] > q[t]]
        for part, found_, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item, x, k) for k, (x, item) in enumerate(sorted(found_, key=lambda f: (-f[0], f[1].encode()))[:most], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize(("least", "kw"), [(1, {}), (2, {"shard_rows": 3, "block_sources": 1}), (1, {"shard_rows": 5, "block_sources": 2, "top": 2}), (99, {})])
def test_divergence(spark, docs, least, kw):
    r = random.Random(least)
    more = [(" ".join(r.choice(["a", "B", "é", "Ω", "中文", "zz", "A"]) for _ in range(r.randrange(30))), r.choice(["x", None, ""]), r.choice(["s1", "s2", "s3", None, "é", "Z"])) for _ in range(80)]
    d = docs.select("text", "lang", "source").union(spark.createDataFrame(more, "text string, lang string, source string"))
    table = [(x[1], x[2], x[3]) for x in rows()] + more
    got = plain(divergence.audit(d.withColumn("term", F.lit(1)).withColumn("n", F.lit("n")), least_docs=least, **kw))
    assert collections.Counter((x["lang"], x["source"], x["part"], x["item"], x["value"], x["rank"]) for x in got) == audited(table, least, kw.get("top", 50))


def test_divergence_of_nothing(spark, empty):
    assert divergence.audit(empty).count() == 0


def test_counts_of_slices_merge(monkeypatch, spark, docs):
    whole = collections.Counter({(x["lang"], x["source"], x["term"]): (x["n"], x["d"]) for x in plain(divergence.partial_counts(docs.coalesce(1)).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))})
    import pyarrow as pa

    raw = docs.select("text", "lang", "source").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(divergence, "SLICE_BYTES", 100)
    monkeypatch.setattr(divergence, "HELD_ROWS", 10)
    parts = pa.Table.from_batches(list(divergence._count(iter([raw])))).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("d", "sum")]).to_pylist()
    assert {(x["lang"], x["source"], x["term"]): (x["n_sum"], x["d_sum"]) for x in parts} == dict(whole)
