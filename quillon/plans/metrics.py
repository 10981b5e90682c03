"""Queries of the metrics over embeddings, documents and lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import stats as S
from .common import halves, table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 2i and 2i + 1 as pair i, alike if their labels agree; 16 pairs are a batch."""
    e = table(spark, sf_dir, "embeddings")
    both = e.groupBy(F.floor(F.col("vec_id") / 2).alias("pair")).agg(F.min_by("embedding", "vec_id").alias("a"), F.max_by("embedding", "vec_id").alias("b"), F.min("label").alias("la"), F.max("label").alias("lb"), F.count("*").alias("n"))
    return both.filter("n = 2").select("pair", F.floor(F.col("pair") / 16).alias("batch"), "a", "b", (F.col("la") == F.col("lb")).cast("double").alias("same"))


def emb_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four similarities of each pair."""
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select("pair", F.round(M.cosine(a, b), 5).alias("cosine"), F.round(-M.euclid(a, b), 5).alias("euclid"), F.round(-M.manhattan(a, b), 4).alias("manhattan"), F.round(M.dot(a, b), 5).alias("dot"))


def emb_pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: Pearson and Spearman of cosine and dot product with likeness."""
    a, b = F.col("a"), F.col("b")
    p = _pairs(spark, sf_dir).select(F.lit(1).alias("g"), "same", F.round(M.cosine(a, b), 9).alias("cosine"), F.round(M.dot(a, b), 9).alias("dot"))
    out = None
    for name in ("cosine", "dot"):
        x = S.pearson(p, ["g"], name, "same").join(S.spearman(p, ["g"], name, "same"), "g").select(F.lit(name).alias("score"), F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"))
        out = x if out is None else out.unionByName(x)
    return out


def emb_infonce_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-batch negatives."""
    s = M.in_batch_scores(_pairs(spark, sf_dir), "batch", "pair", "a", "b")
    m = M.infonce(s, "batch")
    return m.select(*[F.round(c, 5).alias(c) for c in m.columns])


def emb_contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11: contrastive and cosine losses by likeness."""
    a, b = F.col("a"), F.col("b")
    c = _pairs(spark, sf_dir).select("same", M.contrastive(a, b, F.col("same")).alias("l"), ((M.cosine(a, b) - F.col("same")) * (M.cosine(a, b) - F.col("same"))).alias("m"))
    return c.groupBy("same").agg(F.round(F.avg("l"), 5).alias("contrastive"), F.round(F.avg("m"), 5).alias("cosine_mse"))


def emb_centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cosine with its label's mean."""
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return e.join(mean, "label").select("vec_id", F.round(M.cosine(F.col("embedding"), F.col("c")), 5).alias("cosine"))


def rank_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: lines of an order ranked by price, returned ones relevant."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("rel"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("tie"))
    r = M.ranking(li, "l_orderkey", "l_extendedprice", "rel", "tie")
    return r.agg(F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count("*").alias("n"))


def rank_listwise_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11: listwise and pointwise losses of lines by discount, returned ones positive."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("z"), (F.col("l_returnflag") == "R").alias("pos"))
    lw = M.listwise_loss(li, "l_orderkey", "z", F.col("pos"), 0.5).agg(F.round(F.avg("loss"), 5).alias("listwise"), F.count("*").alias("n"))
    pw = li.agg(F.round(F.avg(M.bce(F.col("z"), F.col("pos").cast("double"))), 5).alias("pointwise"))
    return lw.crossJoin(pw)  # one row each


def doc_token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: word lengths as labels, every fifth ignored; the previous word's length capped at 6 is the prediction. A text's first 30 words, as its SQL."""
    return _token_accuracy(spark, sf_dir, F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)), 1, 30))


def doc_token_accuracy_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the same over all words."""
    return _token_accuracy(spark, sf_dir, F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))


def _token_accuracy(spark: SparkSession, sf_dir: str, words: Column) -> DataFrame:
    w = F.transform(words, lambda x: F.length(x))
    d = table(spark, sf_dir, "documents").select("lang", w.alias("w"))
    t = M.token_accuracy(F.transform("w", lambda x: F.least(x, F.lit(6))), F.transform("w", lambda x, i: F.when(i % 5 == 0, -100).otherwise(x)))
    s = d.select("lang", t.alias("t")).groupBy("lang").agg(F.sum("t.right").alias("n_right"), F.sum("t.n").alias("n"), F.sum(F.col("t.all").cast("long")).alias("n_all"))
    return s.withColumn("accuracy", F.round(F.col("n_right") / F.col("n"), 6))


def _box(x1: str, y1: str, w: str, h: str):
    return F.array(*[F.col(c).cast("double") for c in (x1, y1)], (F.col(x1) + F.col(w)).cast("double"), (F.col(y1) + F.col(h)).cast("double"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of a line's numbers: corner by supplier and part, size by quantity and line number."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_quantity", (F.col("l_suppkey") % 20).alias("x"), (F.col("l_partkey") % 20).alias("y"), (F.col("l_quantity") % 13 + 1).alias("w"), (F.col("l_linenumber") + 3).alias("h"))
    return li.select("l_orderkey", "line", "l_quantity", "x", "y", _box("x", "y", "w", "h").alias("box"))


def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box against one fixed box."""
    fixed = F.array(*[F.lit(v) for v in (5.0, 5.0, 15.0, 15.0)])
    b = _boxes(spark, sf_dir)
    return b.groupBy("l_orderkey").agg(F.round(F.sum(M.iou(F.col("box"), fixed)), 6).alias("iou_sum"))


def box_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in thousandths of a 40 by 30 image."""
    b = _boxes(spark, sf_dir).select("l_orderkey", "line", M.normal_box(M.ordered_box(F.col("box")), F.lit(40), F.lit(30)).alias("n"))
    return b.groupBy("l_orderkey").agg(F.count("n").alias("n_valid"), F.sum(F.aggregate("n", F.lit(0), lambda s, x: s + x).cast("long")).alias("total"))


def box_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as text, read back clamped and strict."""
    b = _boxes(spark, sf_dir).withColumn("t", F.concat(F.lit("at <box>"), F.array_join(F.transform("box", lambda v: (v * 40).cast("int").cast("string")), ", "), F.lit("</box>")))
    return b.groupBy("l_orderkey").agg(F.sum(F.size(M.boxes_in(F.col("t"))).cast("long")).alias("n_clamped"), F.sum(F.size(M.boxes_in(F.col("t"), False)).cast("long")).alias("n_strict"))


def box_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order up to quantity 25 against the others, greedy and optimal."""
    b = _boxes(spark, sf_dir)
    sides = b.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when(F.col("l_quantity") <= 25, F.col("box")))).alias("p"), F.array_sort(F.collect_list(F.when(F.col("l_quantity") > 25, F.col("box")))).alias("r"))
    m = sides.select("l_orderkey", M.match_boxes("p", "r").alias("m"))
    return m.select("l_orderkey", *[F.round(f"m.{c}", 6).alias(c) for c in ("greedy", "optimal", "hit_rate")])


def doc_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M4: a text's first half against its second half."""
    a, b = halves("text")
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower(a).alias("a"), F.lower(b).alias("b"))
    s = d.select("doc_id", M.rouge_and_bleu("a", "b").alias("s"))
    return s.select("doc_id", F.round("s.rouge_l", 6).alias("rouge_l"), *[f"s.{c}" for c in ("rouge1", "rouge2", "rougel", "bleu4")])


_P = """p as (select vec_id // 2 pair, arg_min(embedding, vec_id)::double[] a, arg_max(embedding, vec_id)::double[] b, (min(label) = max(label))::int::double same from embeddings group by 1 having count(*) = 2)"""
_COS = "list_cosine_similarity(a, b)"
_B = """b as (select l_orderkey, l_linenumber::bigint line, (l_suppkey % 20)::double x1, (l_partkey % 20)::double y1, l_suppkey % 20 + l_quantity % 13 + 1 x2, (l_partkey % 20 + l_linenumber + 3)::double y2 from lineitem)"""
QUERIES = {
    "emb_pair_scores": (emb_pair_scores, f"with {_P} select pair, round({_COS}, 5) cosine, round(-list_distance(a, b), 5) euclid, round(-list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 4) manhattan, round(list_inner_product(a, b), 5) dot from p"),
    "emb_pair_correlations": (emb_pair_correlations, f"""with {_P}, s as (select same, 'cosine' score, round({_COS}, 9) v from p union all select same, 'dot', round(list_inner_product(a, b), 9) from p),
        r as (select *, rank() over (partition by score order by v) + (count(*) over (partition by score, v) - 1) / 2::double rv, rank() over (partition by score order by same) + (count(*) over (partition by score, same) - 1) / 2::double rs from s)
        select score, round(corr(v, same), 5) pearson, round(corr(rv, rs), 5) spearman from r group by 1"""),
    "emb_infonce_margin": (emb_infonce_margin, f"""with {_P}, x as (select q.pair // 16 batch, q.pair q, d.pair d, list_cosine_similarity(q.a, d.b) s from p q join p d on q.pair // 16 = d.pair // 16),
        g as (select q, max(s) filter (q = d) p, max(s) filter (q <> d) h, sum(s) filter (q <> d) ns, count(*) filter (q <> d) nn, sum(exp(s / 0.1::double)) z from x group by 1)
        select round(avg(p - h), 5) margin, round(avg(p), 5) mean_pos, round(sum(ns) / sum(nn), 5) mean_neg, round(avg(ln(z) - p / 0.1::double), 5) loss from g"""),
    "emb_contrastive_loss": (emb_contrastive_loss, f"with {_P}, c as (select same, {_COS} c from p) select same, round(avg(0.5 * (same * (1 - c) * (1 - c) + (1 - same) * pow(greatest(c - 0.5, 0), 2))), 5) contrastive, round(avg((c - same) * (c - same)), 5) cosine_mse from c group by 1"),
    "emb_centroid_cosine": (emb_centroid_cosine, """with u as (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings), m as (select label, i, avg(x) m from u group by all), c as (select label, list(m order by i) c from m group by 1)
        select vec_id, round(list_cosine_similarity(embedding::double[], c), 5) cosine from embeddings join c using (label)"""),
    "rank_mrr_ndcg": (rank_mrr_ndcg, """with l as (select l_orderkey, (l_returnflag = 'R')::int rel, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey, l_shipdate) r, row_number() over (partition by l_orderkey order by (l_returnflag = 'R')::int desc, l_linenumber) i from lineitem),
        g as (select l_orderkey, coalesce(1.0::double / min(r) filter (rel > 0), 0) mrr, sum((pow(2, rel) - 1) / log2(r + 1)) d, sum((pow(2, rel) - 1) / log2(i + 1)) b from l group by 1 having count(*) >= 2) select round(avg(mrr), 6) mrr, round(avg(case when b > 0 then d / b else 0 end), 6) ndcg, count(*) n from g"""),
    "rank_listwise_loss": (rank_listwise_loss, """with l as (select l_orderkey, l_discount * 10 z, l_returnflag = 'R' pos from lineitem), g as (select l_orderkey, ln(sum(exp(z / 0.5::double))) - max(z / 0.5::double) filter (pos) l from l group by 1 having bool_or(pos))
        select round(avg(l), 5) listwise, count(*) n, (select round(avg(greatest(z, 0) - z * pos::int + ln(1 + exp(-abs(z)))), 5) from l) pointwise from g"""),
    "doc_token_accuracy": (doc_token_accuracy, """with d as (select lang, list_transform(regexp_extract_all(text, '[A-Za-z]+')[1:30], lambda x: length(x)) w from documents), p as (select lang, list_transform(range(1, len(w)), lambda i: {'p': least(w[i], 6), 'y': case when i % 5 = 0 then -100 else w[i + 1] end}) z from d),
        u as (select lang, len(list_filter(z, lambda x: x.y <> -100)) n, len(list_filter(z, lambda x: x.y <> -100 and x.p = x.y)) r from p) select lang, sum(r)::bigint n_right, sum(n)::bigint n, count(*) filter (r = n) n_all, round(sum(r) / sum(n), 6) accuracy from u group by 1"""),
    "box_iou": (box_iou, f"with {_B}, i as (select *, greatest(0, least(x2, 15) - greatest(x1, 5)) * greatest(0, least(y2, 15) - greatest(y1, 5)) i from b) select l_orderkey, round(sum(case when (x2 - x1) * (y2 - y1) + 100 - i > 0 then i / ((x2 - x1) * (y2 - y1) + 100 - i) else 0 end), 6) iou_sum from i group by 1"),
    "box_normalize": (box_normalize, f"""with {_B}, n as (select l_orderkey, greatest(0, least(1000, round_even(x1 * 1000 / 40, 0)::int)) a, greatest(0, least(1000, round_even(y1 * 1000 / 30, 0)::int)) b, greatest(0, least(1000, round_even(x2 * 1000 / 40, 0)::int)) c, greatest(0, least(1000, round_even(y2 * 1000 / 30, 0)::int)) d from b)
        select l_orderkey, count(*) filter (a < c and b < d) n_valid, (sum(a + b + c + d) filter (a < c and b < d))::bigint total from n group by 1"""),
    "box_parse": (box_parse, f"""with {_B} select l_orderkey, count(*) filter (least(1000, trunc(x1 * 40)) < least(1000, trunc(x2 * 40)) and least(1000, trunc(y1 * 40)) < least(1000, trunc(y2 * 40))) n_clamped, count(*) filter (trunc(x1 * 40) < trunc(x2 * 40) and trunc(y1 * 40) < trunc(y2 * 40) and trunc(x2 * 40) <= 1000 and trunc(y2 * 40) <= 1000) n_strict from b group by 1"""),
    "box_matching": (box_matching, None),
    "doc_rouge": (doc_rouge, None),
}
QUERIES["doc_token_accuracy_whole"] = (doc_token_accuracy_whole, QUERIES["doc_token_accuracy"][1].replace("[1:30]", ""))
