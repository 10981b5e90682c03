"""Queries of further selections and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import selection as S
from .common import table


def doc_pilot_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rows over languages and sources, one each at least (more strata than rows)."""
    c = table(spark, sf_dir, "documents").groupBy(F.concat_ws("/", "lang", F.substring("source", 1, 4)).alias("k")).agg(F.count("*").alias("n"))
    return S.pilot_quota(c, "k", "n", 60)


def doc_coverage_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 rows; long texts are mandatory, then uncovered sources, then the least covered ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") > 14000).alias("must"))
    return S.coverage_fill(d, "doc_id", "source", "must", 60)


def doc_group_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 rows to fit and 50 held out; rows of one text are one group."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.md5("text")).alias("a"))
    return S.group_disjoint(d, "doc_id", "a", 100, 50)


def doc_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: 80 rows of 500 characters or more."""
    return S.top_up(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars") >= 500, 80)


def doc_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and test documents of a language with the same text or a shared first line."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), F.md5("text").alias("d"), F.array(F.md5(F.substring_index("text", "\n", 1))).alias("t"))
    return S.evidence_pairs(d, "lang", "doc_id", "split", "d", "t")


def part_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments by short names."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.alias_lookup(F.concat(F.lit(" "), "c_mktsegment"), {"building": "BLD", "machinery": "MCH"}).alias("segment"))


def sel_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares in the 100 largest quantities of a return flag, ties sharing."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    s = S.fractional_top_k(li, "l_quantity", 100, ["l_returnflag"])
    return s.groupBy("l_returnflag", "l_quantity").agg(F.round(F.sum("share"), 6).alias("share")).filter("share > 0")


def sel_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of parts by price."""
    return S.salience_weights(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.round("weight", 6).alias("weight"))


def report_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions over documents."""
    d = table(spark, sf_dir, "documents")
    return R.gates(d, {"enough": F.count("*") >= 100, "few_short": F.avg((F.col("n_chars") < 200).cast("double")) < 0.5, "all_english": F.min((F.col("lang") == "en").cast("int")) == 1})


def report_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks over documents."""
    d = table(spark, sf_dir, "documents")
    return R.validation(d, {"null_text": F.col("text").isNull(), "wrong_length": F.length("text") != F.col("n_chars"), "digits": F.col("text").rlike("[0-9]{10}")})


def report_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of turns by role, and scores out of payloads."""
    c = table(spark, sf_dir, "conversations").select("role", F.when(F.col("turn") % 5 == 4, F.lit("")).otherwise(F.col("text")).alias("t"))
    return R.output_diagnostics(c, ["role"], "t").withColumn("mean_length", F.round("mean_length", 6))


def event_first_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known score of a payload, at the top or under metrics."""
    k = F.get_json_object("props", "$.k")
    p = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"accuracy": '), k, F.lit(', "mean_iou": 7}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"metrics": {"mean_iou": '), k, F.lit("}}"))).otherwise(F.lit('{"score": "x"}'))
    return table(spark, sf_dir, "events").select("event_id", R.first_score(p).alias("score"))


def emb_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector as logits against its reverse."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    r = F.reverse("v")
    return e.select("vec_id", F.round(R.softmax_kl(F.col("v"), r), 5).alias("kl"), F.round(R.centred_mse(F.col("v"), r), 5).alias("mse"), F.round(R.interaction_norm(F.col("v"), r, F.col("v"), F.transform("v", lambda x: x * 2)), 4).alias("interaction"))


def emb_image_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector tiled to an image, its hash and its similarity to its mirror (rows)."""
    px = F.flatten(F.array_repeat(F.transform("embedding", lambda x: x.cast("double") * 100 + 128), 16))
    e = table(spark, sf_dir, "embeddings").select("vec_id", px.alias("p"))
    return e.select("vec_id", R.perceptual_hash("p").alias("phash"), F.round(R.global_similarity(F.col("p"), F.reverse("p")), 6).alias("similarity"))


def eval_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tasks over parts: the name as reference, a changed one as prediction (rows)."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    task = (k % 5 + 1).cast("int")
    box = F.array(*[F.lit(float(v)) for v in (10, 10, 200, 200)])
    df = p.select(
        task.alias("task_id"), F.concat(F.lit("Q?\nA. "), "p_name", F.lit("\nB. "), "p_type").alias("prompt"),
        F.when(task <= 2, F.concat(F.lit("A. "), "p_name")).when(task == 3, F.concat_ws("; ", "p_name", "p_type")).when(task == 5, F.concat("p_type", F.lit(" final answer: A. "), "p_name")).otherwise("").alias("reference"),
        F.when(task <= 2, F.when(k % 3 == 0, "B").otherwise("A")).when(task == 3, F.concat(F.col("p_name"), F.lit("; uncertain other"))).when(task == 4, F.lit("<box>10,10,200,100</box>")).otherwise(F.concat("p_type", F.lit(" final answer: A"))).alias("prediction"),
        F.array(box).alias("boxes"),
    )
    e = R.evaluate(df)
    return e.select("task_id", "total", "nonempty", *[F.round(c, 5).alias(c) for c in ("metric_a", "metric_b", "primary_score")], "status")


_H = lambda p, k="doc_id": f"sha256('42|{p}|' || {k}::varchar)"
QUERIES = {
    "doc_pilot_quota": (doc_pilot_quota, """with c as (select lang || '/' || substring(source, 1, 4) k, count(*) n from documents group by 1), a as (select *, sum(n) over () t from c), q as (select *, greatest(1, 60 * n // t) q, 60 * n - greatest(1, 60 * n // t) * t m, from a),
        r as (select *, least(60, t) - sum(q) over () l, row_number() over (order by m desc, k) r from q), g as (select k, unnest(range(1, q::bigint)) g, r, l from r where l < 0), tk as (select k, count(*) taken from (select k, row_number() over (order by g, r desc) i, l from g) where i <= -l group by 1)
        select r.k, n, (q + case when l > 0 and r <= l then 1 else 0 end - coalesce(taken, 0))::bigint quota from r left join tk using (k)"""),
    "doc_coverage_fill": (doc_coverage_fill, f"""with d as (select doc_id, source, n_chars > 14000 must from documents), c as (select source, count(*) filter (must) c from d group by 1), f as (select d.*, c, row_number() over (partition by source order by {_H('coverage')}, doc_id) i from d join c using (source) where not must),
        p as (select doc_id, source, must, case when c = 0 and i = 1 then 'coverage' else 'balance' end why from f order by (c = 0 and i = 1) desc, c + i, {_H('coverage')}, doc_id limit greatest(0, 60 - (select count(*) from d where must)))
        select doc_id, source, must, 'mandatory' why from d where must union all select * from p"""),
    "doc_group_disjoint": (doc_group_disjoint, f"""with r as (select doc_id, text, row_number() over (order by {_H('split')}, doc_id) r from documents), h as (select doc_id from r where r > 100 and text not in (select text from r where r <= 100) order by r limit 50)
        select doc_id, 'fit' part from r where r <= 100 union all select doc_id, 'holdout' from h"""),
    "doc_top_up": (doc_top_up, f"select doc_id, n_chars from documents where n_chars >= 500 order by {_H('topup')}, doc_id limit 80"),
    "doc_evidence": (doc_evidence, """with d as (select doc_id, lang, doc_id % 5 = 0 test, text, string_split(text, chr(10))[1] l from documents) select a.lang, a.doc_id train, b.doc_id test, a.text = b.text same_digest, (a.l = b.l)::bigint n_shared from d a join d b on a.lang = b.lang and not a.test and b.test and (a.text = b.text or a.l = b.l)"""),
    "part_aliases": (part_aliases, "select c_custkey, case lower(c_mktsegment) when 'building' then 'BLD' when 'machinery' then 'MCH' else ' ' || c_mktsegment end segment from customer"),
    "sel_top_share": (sel_top_share, """with c as (select l_returnflag, l_quantity, count(*) c from lineitem group by all), p as (select *, coalesce(sum(c) over (partition by l_returnflag order by l_quantity desc rows between unbounded preceding and 1 preceding), 0) p from c) select l_returnflag, l_quantity, round(greatest(0, least(c, 100 - p)), 6)::double share from p where p < 100"""),
    "sel_salience": (sel_salience, "select p_partkey, round(1 + 0.25::double * (p_retailprice - avg(p_retailprice) over ()) / max(p_retailprice) over (), 6) weight from part"),
    "report_gates": (report_gates, """with g as (select count(*) >= 100 a, avg((n_chars < 200)::int) < 0.5 b, bool_and(lang = 'en') c from documents) select 'enough' gate, a passed from g union all select 'few_short', b from g union all select 'all_english', c from g union all select 'ALL', a and b and c from g"""),
    "report_validation": (report_validation, """with c as (select count(*) filter (text is null) a, count(*) filter (length(text) <> n_chars) b, count(*) filter (regexp_matches(text, '[0-9]{10}')) c from documents), u as (select 'null_text' as check, a n_errors from c union all select 'wrong_length', b from c union all select 'digits', c from c) select *, case when n_errors = 0 then 'PASS' else 'FAIL' end status from u"""),
    "report_outputs": (report_outputs, "with t as (select role, case when turn % 5 = 4 then '' else text end t from conversations) select role, count(*) n, round(avg(length(t)), 6) mean_length, max(length(t)) max_length, count(*) filter (t = '') n_empty from t group by 1"),
    "event_first_score": (event_first_score, "select event_id, case when event_id % 3 < 2 then (props->>'$.k')::double end score from events"),
    "emb_logits": (emb_logits, """with u as (select vec_id, unnest(embedding)::double a, unnest(list_reverse(embedding))::double b from embeddings), z as (select *, a - ln(sum(exp(a)) over (partition by vec_id)) la, b - ln(sum(exp(b)) over (partition by vec_id)) lb, a - avg(a) over (partition by vec_id) ca, b - avg(b) over (partition by vec_id) cb from u)
        select vec_id, round(greatest(0, sum(exp(la) * (la - lb))), 5) kl, round(avg((ca - cb) * (ca - cb)), 5) mse, round(sum((cb - ca - 2 * ca + ca) * (cb - ca - 2 * ca + ca)), 4) interaction from z group by 1"""),
    "emb_image_hash": (emb_image_hash, None),
    "eval_tasks": (eval_tasks, None),
}
