"""Evaluation metrics: accuracy, retrieval, embedding similarity, contrastive and ranking losses, boxes, ROUGE."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def token_accuracy(predicted: Column, labels: Column, ignore: int = -100) -> Column:
    """struct<right, n, all>: predictions against the next label, ignored labels left out (M1)."""
    pairs = F.zip_with(F.slice(predicted, 1, F.greatest(F.size(predicted) - 1, F.lit(0))), F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, y: F.struct(p.alias("p"), y.alias("y")))
    used = F.filter(pairs, lambda x: x["y"] != ignore)
    right = F.size(F.filter(used, lambda x: x["p"] == x["y"]))
    return F.struct(right.cast("long").alias("right"), F.size(used).cast("long").alias("n"), (right == F.size(used)).alias("all"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


#: Rows of a batch whose queries meet all its documents.
MOST_IN_BATCH = 65_536


def in_batch_scores(pairs: DataFrame, batch: str, key: str, query: str, doc: str, most: int = MOST_IN_BATCH) -> DataFrame:
    """(batch, q, d, score): every query against every document of its batch (C10). A batch is what one training step takes, so one of more than `most` rows is an error."""
    largest = pairs.groupBy(batch).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a batch has {largest} rows; at most {most} meet one another")
    q = pairs.select(batch, F.col(key).alias("q"), F.col(query).alias("_q"))
    d = pairs.select(F.col(batch).alias("_b"), F.col(key).alias("d"), F.col(doc).alias("_d"))
    return q.join(d, F.col(batch) == F.col("_b")).select(batch, "q", "d", cosine(F.col("_q"), F.col("_d")).alias("score"))


def infonce(scores: DataFrame, batch: str, tau: float = 0.1) -> DataFrame:
    """Margin (positive less hardest negative), mean positive and negative, and loss, over all queries (M6)."""
    pos, neg = F.col("q") == F.col("d"), F.col("q") != F.col("d")
    per = scores.groupBy(batch, "q").agg(
        F.max(F.when(pos, F.col("score"))).alias("p"), F.max(F.when(neg, F.col("score"))).alias("hard"), F.sum(F.when(neg, F.col("score"))).alias("ns"), F.sum(neg.cast("long")).alias("nn"), F.sum(F.exp(F.col("score") / tau)).alias("z")
    )
    return per.agg(F.avg(F.col("p") - F.col("hard")).alias("margin"), F.avg("p").alias("mean_pos"), (F.sum("ns") / F.sum("nn")).alias("mean_neg"), F.avg(F.ln("z") - F.col("p") / tau).alias("loss"))


def ranking(df: DataFrame, group: str, score: str, relevance: str, tie: str) -> DataFrame:
    """(group, mrr, ndcg) of groups with two rows or more; no positive gives 0 (E6, M7). Gain 2^rel - 1, log2 discount."""
    w = W.partitionBy(group)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), tie))).withColumn("_i", F.row_number().over(w.orderBy(F.desc(relevance), tie)))
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    log2 = lambda c: F.ln(c + 1.0) / math.log(2)
    g = r.groupBy(group).agg(F.count("*").alias("_n"), F.min(F.when(F.col(relevance) > 0, F.col("_r"))).alias("_f"), F.sum(gain / log2(F.col("_r"))).alias("_d"), F.sum(gain / log2(F.col("_i"))).alias("_b"))
    return g.filter("_n >= 2").select(group, F.coalesce(1.0 / F.col("_f"), F.lit(0.0)).alias("mrr"), F.when(F.col("_b") > 0, F.col("_d") / F.col("_b")).otherwise(0.0).alias("ndcg"))


def listwise_loss(df: DataFrame, group: str, logit: str, positive: Column, tau: float = 1.0) -> DataFrame:
    """(group, loss): -log softmax of the group's positive."""
    z = F.col(logit) / tau
    g = df.groupBy(group).agg(F.max(z).alias("_m"), F.max(F.when(positive, z)).alias("_p"))
    s = df.join(g, group).groupBy(group).agg(F.sum(F.exp(z - F.col("_m"))).alias("_s"), F.first("_m").alias("_m"), F.first("_p").alias("_p"))
    return s.filter("_p is not null").select(group, (F.ln("_s") + F.col("_m") - F.col("_p")).alias("loss"))


def bce(logit: Column, label: Column) -> Column:
    """Binary cross-entropy with logits, stable for large values."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.ln(1 + F.exp(-F.abs(logit)))


def contrastive(a: Column, b: Column, label: Column, margin: float = 0.5) -> Column:
    """0.5 (l d^2 + (1 - l) max(margin - d, 0)^2) with cosine distance d."""
    d = 1 - cosine(a, b)
    far = F.greatest(F.lit(margin) - d, F.lit(0.0))
    return 0.5 * (label * d * d + (1 - label) * far * far)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x1, y1, x2, y2]; 0 without union."""
    g = lambda x, i: F.get(x, F.lit(i))
    side = lambda i: F.greatest(F.lit(0.0), F.least(g(a, i + 2), g(b, i + 2)) - F.greatest(g(a, i), g(b, i)))
    area = lambda x: (g(x, 2) - g(x, 0)) * (g(x, 3) - g(x, 1))
    inter = side(0) * side(1)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def normal_box(box: Column, width: Column, height: Column) -> Column:
    """Box in thousandths, half-even rounding, clamped; null if degenerate."""
    put = lambda i, n: F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(F.get(box, F.lit(i)) * 1000 / F.nullif(n, F.lit(0)), 0).cast("int")))
    x1, y1, x2, y2 = put(0, width), put(1, height), put(2, width), put(3, height)
    return F.when((x1 < x2) & (y1 < y2), F.array(x1, y1, x2, y2))


def ordered_box(box: Column) -> Column:
    """Corners swapped where needed; only boxes of 2 or 4 numbers."""
    g = lambda i: F.get(box, F.lit(i))
    return F.when(F.size(box) == 4, F.array(F.least(g(0), g(2)), F.least(g(1), g(3)), F.greatest(g(0), g(2)), F.greatest(g(1), g(3)))).when(F.size(box) == 2, box)


def boxes_in(text: Column, clamp: bool = True) -> Column:
    """Boxes in `<box>x1,y1,x2,y2</box>`: clamped to 0..1000, or refused outside it (I2); corners must be in order."""
    raw = F.regexp_extract_all(text, F.lit(r"(?i)<box>\s*([^<]+?)\s*</box>"), F.lit(1))
    numbers = F.transform(raw, lambda r: F.transform(F.slice(F.regexp_extract_all(r, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), 1, 4), lambda x: x.cast("double")))
    if clamp:
        numbers = F.transform(numbers, lambda b: F.transform(b, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), v))))
    fine = lambda b: (F.size(b) == 4) & (F.get(b, 0) < F.get(b, 2)) & (F.get(b, 1) < F.get(b, 3)) & F.forall(b, lambda v: v.between(0.0, 1000.0))
    return F.filter(numbers, fine)


def _pairwise(p: list, r: list) -> list[list[float]]:
    def one(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(0.0, w) * max(0.0, h)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        return inter / union if union > 0 else 0.0

    return [[one(a, b) for b in r] for a in p]


def greedy_score(m: list[list[float]], n_reference: int) -> float:
    """Best pairs first, each box once, over the number of references (I4)."""
    cells = sorted(((-v, i, j) for i, row in enumerate(m) for j, v in enumerate(row)))
    left, right, total = set(), set(), 0.0
    for v, i, j in cells:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            total -= v
    return total / n_reference if n_reference else 0.0


def assignment(m: list[list[float]]) -> list[int]:
    """The column of each row in the assignment of greatest sum, -1 for none (I5): shortest augmenting paths with potentials."""
    rows, cols = len(m), len(m[0]) if m else 0
    if not rows or not cols:
        return [-1] * rows
    n = max(rows, cols)
    cost = [[-(m[i][j]) if i < rows and j < cols else 0.0 for j in range(n)] for i in range(n)]
    u, v, owner = [0.0] * n, [0.0] * (n + 1), [-1] * (n + 1)
    for i in range(n):
        owner[n], at = i, n
        best, back, done = [math.inf] * n, [n] * n, [False] * (n + 1)
        while owner[at] >= 0:
            done[at] = True
            row, step, nxt = owner[at], math.inf, -1
            for j in range(n):
                if not done[j]:
                    c = cost[row][j] - u[row] - v[j]
                    if c < best[j]:
                        best[j], back[j] = c, at
                    if best[j] < step:
                        step, nxt = best[j], j
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                elif j < n:
                    best[j] -= step
            at = nxt
        while at != n:
            owner[at] = owner[back[at]]
            at = back[at]
    out = [-1] * rows
    for j in range(cols):
        if 0 <= owner[j] < rows:
            out[owner[j]] = j
    return out


@F.pandas_udf(_doubles("greedy", "optimal", "hit_rate"))
def match_boxes(predicted: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Greedy and optimal mean IoU over references, and the share of references met with 0.5 or more."""
    out = []
    for p, r in zip(predicted, reference, strict=True):
        p, r = [list(x) for x in p] if p is not None else [], [list(x) for x in r] if r is not None else []
        if not p or not r:
            out.append((0.0, 0.0, 0.0))
            continue
        m = _pairwise(p, r)
        got = [m[i][j] for i, j in enumerate(assignment(m)) if j >= 0]
        out.append((greedy_score(m, len(r)), sum(got) / len(r), sum(x >= 0.5 for x in got) / len(r)))
    return pd.DataFrame(out, columns=["greedy", "optimal", "hit_rate"])


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors over a."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for y in b:
        u = state & places.get(y, 0)
        state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    """ROUGE-L F1 of white-space tokens; 0 if either is empty (M4)."""
    out = []
    for r, p in zip(reference, prediction, strict=True):
        a, b = (r or "").split(), (p or "").split()
        n = lcs_length(a, b) if a and b else 0
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out)


def _scores(a: list[str], b: list[str], n: int) -> tuple[float, ...]:
    """ROUGE-1, -2, -L and BLEU-4 of two texts' words, n the length of their common subsequence."""
    from collections import Counter

    grams = lambda t, k: Counter(zip(*(t[i:] for i in range(k))))
    hits, own, other = [], [], []
    for k in range(1, 5):
        x, y = grams(a, k), grams(b, k)
        hits.append(sum(min(c, y[w]) for w, c in x.items() if w in y))
        own.append(max(len(a) - k + 1, 0))
        other.append(max(len(b) - k + 1, 0))
    row = [200 * hits[k] / (own[k] + other[k]) if own[k] + other[k] else 0.0 for k in (0, 1)]
    row.append(200 * n / (len(a) + len(b)))
    log, half = 0.0, 1.0
    for hit, under in zip(hits, (max(1, m) for m in other), strict=True):
        if hit == 0:
            half *= 2
        log += math.log(hit / under if hit else 1 / (half * under)) / 4
    row.append(100 * math.exp(log + min(0.0, 1 - len(a) / len(b))))
    return tuple(round(v, 6) for v in row)


@F.pandas_udf(_doubles("rouge1", "rouge2", "rougel", "bleu4"))
def text_scores(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """ROUGE-1, -2, -L F1 and BLEU-4 (counts of 0 halved in turn) in percent; null if either is empty (M3)."""
    return _all_scores(reference, prediction).drop(columns="rouge_l")


def _all_scores(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    out = []
    for r, p in zip(reference, prediction, strict=True):
        a, b = (r or "").split(), (p or "").split()
        n = lcs_length(a, b) if a and b else 0
        out.append((2 * n / (len(a) + len(b)) if n else 0.0, *(_scores(a, b, n) if a and b else (None,) * 4)))
    return pd.DataFrame(out, columns=["rouge_l", "rouge1", "rouge2", "rougel", "bleu4"])


@F.pandas_udf(_doubles("rouge_l", "rouge1", "rouge2", "rougel", "bleu4"))
def rouge_and_bleu(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """`rouge_l` and `text_scores` at once, so that the common subsequence is found once (M3, M4)."""
    return _all_scores(reference, prediction)
