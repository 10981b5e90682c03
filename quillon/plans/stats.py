"""Queries of the aggregates over documents, labels, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from .common import HALVES_SQL, halves, table


def _r(df: DataFrame, *cols: str, d: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, d))
    return df


def doc_len_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths by source."""
    return _r(S.length_stats(table(spark, sf_dir, "documents"), ["source"], "n_chars"), "mean", "std")


def doc_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile of length by language, four ways."""
    return _r(S.percentiles(table(spark, sf_dir, "documents"), ["lang"], "n_chars", 0.95), "linear")


def doc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and length class."""
    d = table(spark, sf_dir, "documents").withColumn("k", F.least(F.lit(9), F.floor(F.col("n_chars") / 500)).cast("long"))
    return d.groupBy("lang", "k").agg(F.count("*").alias("n"))


def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often "long enough" agrees with quality, by language; unlabelled rows are invalid."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ok = F.coalesce((F.col("n_chars") >= 1000).cast("int") == F.col("quality"), F.lit(False)).cast("double")
    return _r(j.groupBy("lang").agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("accuracy"), F.avg(F.col("quality").isNull().cast("double")).alias("invalid_rate"), F.count("*").alias("n")), "accuracy", "invalid_rate")


def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality against toxicity."""
    return _r(S.confusion(table(spark, sf_dir, "labels"), "quality", "toxic"), "recall")


def label_micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-line words as prediction of a text's first 20 words, by language."""
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    d = table(spark, sf_dir, "documents").select("lang", w(F.substring("text", 1, 120)).alias("gold"), w(F.substring_index("text", "\n", 1)).alias("pred"))
    return _r(S.micro_f1(d, ["lang"], "gold", "pred"), "f1")


def doc_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Jaccard of the words of a text's first and second hundred characters, by source."""
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    d = table(spark, sf_dir, "documents").select("source", w(F.substring("text", 1, 100)).alias("a"), w(F.substring("text", 101, 100)).alias("b"))
    return _r(d.groupBy("source").agg(F.avg(S.jaccard(F.col("a"), F.col("b"))).alias("jaccard")), "jaccard")


def label_micro_f1_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-line words as prediction of the words of all the rest, by language."""
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    first = F.substring_index("text", "\n", 1)
    d = table(spark, sf_dir, "documents").select("lang", w(F.substring("text", F.length(first) + 2, F.length("text"))).alias("gold"), w(first).alias("pred"))
    return _r(S.micro_f1(d, ["lang"], "gold", "pred"), "f1")


def doc_jaccard_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Jaccard of the words of a text's first and second half, by source."""
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    a, b = halves("text")
    d = table(spark, sf_dir, "documents").select("source", w(a).alias("a"), w(b).alias("b"))
    return _r(d.groupBy("source").agg(F.avg(S.jaccard(F.col("a"), F.col("b"))).alias("jaccard")), "jaccard")


def label_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths overall and by language, quality and toxicity."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return _r(S.diagnostics(j, ["lang", "quality", "toxic"], "n_chars"), "mean", "median")


def doc_error_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several faults counted in one pass."""
    d = table(spark, sf_dir, "documents")
    return S.counters(d, [("short", F.col("n_chars") < 200), ("shouting", F.col("text").rlike("[A-Z]{12,}")), ("no_newline", ~F.contains("text", F.lit("\n"))), ("mail", F.contains("text", F.lit("@"))), ("wrong_length", F.length("text") != F.col("n_chars"))])


def doc_first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing rule of each document, counted."""
    d = table(spark, sf_dir, "documents")
    why = S.reasons(d, [("short", F.col("n_chars") < 300), ("shouting", F.col("text").rlike("[A-Z]{12,}")), ("mail", F.contains("text", F.lit("@")))])
    return d.groupBy(F.coalesce(why, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def sel_hhi_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of order value over customers, by status."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return _r(S.concentration(o, ["o_orderstatus"], "v"), "hhi", "entropy")


def sel_rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks of quantity within a return flag, summed by line number."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    r = S.average_rank(li, ["l_returnflag"], "l_quantity", "r")
    return r.groupBy("l_returnflag", "l_linenumber").agg(F.round(F.sum("r"), 2).alias("rank_sum"))


def sel_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson and Spearman of quantity and price, by return flag; a constant side gives null."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", F.lit(1.0).alias("one"))
    a, b, c = S.pearson(li, ["l_returnflag"], "l_quantity", "l_extendedprice"), S.spearman(li, ["l_returnflag"], "l_quantity", "l_extendedprice"), S.pearson(li, ["l_returnflag"], "l_quantity", "one", "constant")
    return _r(a.join(b, "l_returnflag").join(c, "l_returnflag"), "pearson", "spearman", "constant")


def sel_sign_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two deviations have the same sign, zeros being those within 1e-12."""
    s = lambda x: F.when(F.abs(x) <= 1e-12, 0).otherwise(F.signum(x).cast("int"))
    li = table(spark, sf_dir, "lineitem")
    return _r(li.groupBy("l_returnflag").agg(F.avg((s(F.col("l_discount") - 0.05) == s(F.col("l_tax") - 0.04)).cast("double")).alias("agreement")), "agreement")


def sel_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does length tell quality? AUROC and effect by language."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return _r(S.effect_size(j, ["lang"], "quality", "n_chars"), "auroc", "effect")


def sel_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted gains and effective sample size of lines, by ship status."""
    return _r(S.weighted_ledger(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", "l_discount"), "gain", "ess", "max_share")


def event_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: last value of each user counts; values and users a second of each event type."""
    from ..operators.joins import last_write

    e = last_write(table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value"), ["event_type", "user_id"], "event_id")
    return _r(e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), (F.sum("value") / F.lit(60.0)).alias("per_second")), "total", "per_second", d=4)


_W = "list_distinct(regexp_extract_all(lower({}), '[a-z]+'))"
QUERIES = {
    "doc_len_stats": (doc_len_stats, "select source, round(avg(n_chars), 6) mean, round(stddev_pop(n_chars), 6) std, min(n_chars)::double min, max(n_chars)::double max, count(*) size from documents group by source"),
    "doc_percentiles": (doc_percentiles, """with r as (select lang, list(n_chars order by n_chars) v, count(*) n, quantile_cont(n_chars::double, 0.95) linear from documents group by lang)
        select lang, v[ceil(n * 0.95::double)::int] nearest, v[least(floor(n * 0.95::double), n - 1)::int + 1] as "floor", v[(n // 2)::int + 1] median_high, round(linear, 6) linear from r"""),
    "doc_histogram": (doc_histogram, "select lang, least(9, n_chars // 500)::bigint k, count(*) n from documents group by all"),
    "label_accuracy": (label_accuracy, "select lang, round(avg(coalesce((n_chars >= 1000)::int = quality, false)::int), 6) accuracy, round(avg((quality is null)::int), 6) invalid_rate, count(*) n from documents left join labels using (doc_id) group by lang"),
    "label_confusion": (label_confusion, "with c as (select quality, toxic, count(*) n from labels group by all) select quality, toxic, n, case when quality = toxic then round(n / sum(n) over (partition by quality), 6) end::double recall from c"),
    "label_micro_f1": (label_micro_f1, f"""with d as (select lang, {_W.format('substring(text, 1, 120)')} g, {_W.format("string_split(text, chr(10))[1]")} p from documents), s as (select lang, sum(len(list_intersect(g, p)))::bigint tp, sum(len(p) - len(list_intersect(g, p)))::bigint fp, sum(len(g) - len(list_intersect(g, p)))::bigint fn from d group by lang)
        select *, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end, 6) f1 from s"""),
    "doc_jaccard": (doc_jaccard, f"""with d as (select source, {_W.format('substring(text, 1, 100)')} a, {_W.format('substring(text, 101, 100)')} b from documents), u as (select *, len(list_distinct(list_concat(a, b))) u, len(list_intersect(a, b)) i from d)
        select source, round(avg(case when u = 0 then 1.0 else i / u::double end), 6) jaccard from u group by source"""),
    "label_grouping_sets": (label_grouping_sets, """with j as (select lang, quality, toxic, n_chars from documents join labels using (doc_id)), u as (select 'all' as level, '' as key, n_chars from j union all select 'lang', lang, n_chars from j union all select 'quality', coalesce(quality::varchar, 'null'), n_chars from j union all select 'toxic', coalesce(toxic::varchar, 'null'), n_chars from j)
        select level, key, count(*) n, round(avg(n_chars), 6) mean, round(median(n_chars), 6)::double median from u group by all"""),
    "doc_error_counters": (doc_error_counters, """with c as (select count(*) filter (n_chars < 200) short, count(*) filter (regexp_matches(text, '[A-Z]{12,}')) shouting, count(*) filter (not contains(text, chr(10))) no_newline, count(*) filter (contains(text, '@')) mail, count(*) filter (length(text) <> n_chars) wrong_length from documents)
        unpivot c on short, shouting, no_newline, mail, wrong_length into name reason value n"""),
    "doc_first_reason": (doc_first_reason, "select case when n_chars < 300 then 'short' when regexp_matches(text, '[A-Z]{12,}') then 'shouting' when contains(text, '@') then 'mail' else 'ok' end reason, count(*) n from documents group by 1"),
    "sel_hhi_entropy": (sel_hhi_entropy, "with o as (select o_orderstatus, o_custkey, sum(o_totalprice) v from orders group by all), p as (select o_orderstatus, v / sum(v) over (partition by o_orderstatus) p from o) select o_orderstatus, round(sum(p * p), 6) hhi, round(sum(case when p > 0 then -p * ln(p) else 0 end), 6) entropy from p group by 1"),
    "sel_rank_ties": (sel_rank_ties, "with r as (select l_returnflag, l_linenumber, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 r from lineitem) select l_returnflag, l_linenumber, round(sum(r), 2)::double rank_sum from r group by all"),
    "sel_correlations": (sel_correlations, """with r as (select l_returnflag, l_quantity q, l_extendedprice p, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2::double rq, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2::double rp from lineitem)
        select l_returnflag, round(corr(q, p), 6) pearson, round(corr(rq, rp), 6) spearman, null::double as "constant" from r group by 1"""),
    "sel_sign_agreement": (sel_sign_agreement, """with s as (select l_returnflag, case when abs(l_discount - 0.05::double) <= 1e-12 then 0 else sign(l_discount - 0.05::double) end a, case when abs(l_tax - 0.04::double) <= 1e-12 then 0 else sign(l_tax - 0.04::double) end b from lineitem) select l_returnflag, round(avg((a = b)::int), 6) agreement from s group by 1"""),
    "sel_effect": (sel_effect, """with j as (select lang, quality, n_chars from documents join labels using (doc_id) where quality is not null and n_chars is not null), r as (select *, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2::double r from j),
        a as (select lang, sum(quality)::double n1, sum(1 - quality)::double n0, sum(r) filter (quality = 1) s from r group by lang) select lang, case when n1 > 0 and n0 > 0 then round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) end auroc, case when n1 > 0 and n0 > 0 then round(2 * (s - n1 * (n1 + 1) / 2) / (n1 * n0) - 1, 6) end effect from a"""),
    "sel_ledger": (sel_ledger, "select l_linestatus, round(sum(l_quantity * l_discount), 6) gain, round(sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity), 6) ess, round(max(l_quantity) / sum(l_quantity), 6) max_share from lineitem group by 1"),
    "event_throughput": (event_throughput, "with l as (select event_type, user_id, arg_max(value, event_id) v from events group by all) select event_type, count(*) n, round(sum(v), 4) total, round(sum(v) / 60.0::double, 4) per_second from l group by 1"),
}
QUERIES["label_micro_f1_whole"] = (label_micro_f1_whole, QUERIES["label_micro_f1"][1].replace("substring(text, 1, 120)", "substring(text, length(string_split(text, chr(10))[1]) + 2)"))
QUERIES["doc_jaccard_whole"] = (doc_jaccard_whole, QUERIES["doc_jaccard"][1].replace("substring(text, 1, 100)", HALVES_SQL[0]).replace("substring(text, 101, 100)", HALVES_SQL[1]))
