"""Queries of the joins: leakage, overlaps, duplicates, near pairs, components, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from .common import table


def join_four_way_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to customers, nations and lines; why some fail. Stand-ins: customers with negative balance, nations
    over 20 and lines with quantity up to 45 are missing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").filter("n_nationkey <= 20").select("n_nationkey", "n_name")
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    li = J.last_write(li, ["o_orderkey"], "l_linenumber")
    joined = J.chain_join(o, [("customer", c, ["c_custkey"]), ("nation", n, ["n_nationkey"]), ("line", li, ["o_orderkey"])])
    return joined.groupBy(F.coalesce("missing", F.lit("none")).alias("missing")).agg(F.count("*").alias("n"))


def join_provenance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against a changed copy (segment of every 7th, balance of every 11th)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    k = F.col("c_custkey")
    other = c.select("c_custkey", F.when(k % 7 == 0, "X").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"), "c_nationkey")
    return J.drift(c, other, "c_custkey", ["c_mktsegment", "c_acctbal", "c_nationkey"]).select("c_custkey", F.array_join("fields", ",").alias("fields"))


def doc_exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, and how often it comes again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return J.first_of_each(d, "digest", "doc_id").filter("n_later > 0")


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as train and test (every fifth), tokens: the digests of their lines of 40 characters or more."""
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 40), lambda x: F.md5(x.cast("binary"))))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("side"), lines.alias("tokens"))


def doc_token_leak_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: training documents that share no long line with a test document."""
    s = _sides(spark, sf_dir)
    return J.without_shared_tokens(s.filter("side = 'train'"), s.filter("side = 'test'"), "doc_id", "tokens").select("doc_id")


def doc_split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lines that stand on both sides."""
    s = _sides(spark, sf_dir).select("doc_id", "side", F.explode("tokens").alias("token"))
    return J.overlaps(s, "token", "side")


def doc_hash_overlap_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a whole line that is a benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.array(F.md5(T.norm_ascii(F.col("text")).cast("binary"))).alias("tokens"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.md5(T.norm_ascii(x).cast("binary"))).alias("tokens"))
    return J.without_shared_tokens(d, items, "doc_id", "tokens").select("doc_id")


def doc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by shared long lines (rows, components by the smallest id)."""
    return J.token_components(_sides(spark, sf_dir), "doc_id", "tokens")


def _bits(base: int):
    """Signs of 32 dimensions as an unsigned number."""
    each = F.transform(F.slice("embedding", base + 1, 32), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def emb_hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes at most 4 bits apart; stand-in: two vectors share a digest, some of whose low bits are flipped by number."""
    half = lambda at: F.conv(F.substring(F.md5(F.floor(F.col("vec_id") / 2).cast("string").cast("binary")), at, 8), 16, 10).cast("long")
    e = table(spark, sf_dir, "embeddings").select("vec_id", half(1).alias("h"), half(9).bitwiseXOR(F.expr("shiftleft(1L, cast(vec_id % 7 as int)) - 1")).alias("l"))
    return J.hamming_pairs(e, "vec_id", "h", "l", 4)


def doc_vocab_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ten uses or more with their usual spelling."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w"))
    return J.vocabulary(w.select("w", F.lower("w").alias("norm")), "w", "norm").filter("n >= 10")


def doc_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of test documents that no training document has, by language."""
    w = _sides(spark, sf_dir).select("doc_id", "side").join(table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")), "doc_id")
    known = w.filter("side = 'train'").select("w").distinct()
    new = w.filter("side = 'test'").groupBy("lang", "w").agg(F.count("*").alias("c")).join(known, "w", "left_anti")
    return new.groupBy("lang").agg(F.count("*").alias("n_unique"), F.sum("c").alias("n_uses"))


def event_cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: events whose content digest was seen in January's first half."""
    e = table(spark, sf_dir, "events").withColumn("d", F.md5(F.concat_ws("|", "event_type", F.floor("value").cast("long").cast("string")).cast("binary")))
    old = e.filter("ts < '2024-01-15'").select("d").distinct()
    return e.filter("ts >= '2024-01-15'").join(old, "d", "left_semi").groupBy("event_type").agg(F.count("*").alias("n_cached"))


def doc_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: documents to the worker of their language."""
    return J.route(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["de", "en", "es", "fr"])


def order_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer, greatest finished less greatest open order."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    return J.gap(o, ["o_custkey"], "o_orderstatus", "o_totalprice", "F", "O").withColumn("gap", F.round("gap", 4))


def doc_left_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left-joined to labels; missing and non-quality ones counted by source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("quality").isNull().cast("long")).alias("n_missing"), F.sum(F.coalesce((F.col("quality") == 0).cast("long"), F.lit(0))).alias("n_poor"))


_SIDES = """s as (select doc_id, lang, case when doc_id % 5 = 0 then 'test' else 'train' end side, text from documents),
    t as (select distinct doc_id, side, md5(x) token from (select doc_id, side, unnest(string_split(text, chr(10))) x from s) where length(x) >= 40)"""
QUERIES = {
    "join_four_way_errors": (join_four_way_errors, """with li as (select l_orderkey from lineitem where l_quantity > 45 group by 1), j as (select case when c.c_custkey is null then 'customer' when n.n_nationkey is null then 'nation' when l_orderkey is null then 'line' else 'none' end missing
        from orders o left join (select * from customer where c_acctbal >= 0) c on o_custkey = c.c_custkey left join (select * from nation where n_nationkey <= 20) n on c_nationkey = n.n_nationkey left join li on l_orderkey = o_orderkey) select missing, count(*) n from j group by 1"""),
    "join_provenance_drift": (join_provenance_drift, """select c_custkey, concat_ws(',', case when c_custkey % 7 = 0 and c_mktsegment <> 'X' then 'c_mktsegment' end, case when c_custkey % 11 = 0 and c_acctbal is not null then 'c_acctbal' end) fields from customer where c_custkey % 7 = 0 or c_custkey % 11 = 0"""),
    "doc_exact_dup": (doc_exact_dup, "select sha256(text) digest, min(doc_id) doc_id, count(*) - 1 n_later from documents group by text having count(*) > 1"),
    "doc_token_leak_antijoin": (doc_token_leak_antijoin, f"with {_SIDES} select doc_id from s where side = 'train' and doc_id not in (select doc_id from t where side = 'train' and token in (select token from t where side = 'test'))"),
    "doc_split_audit": (doc_split_audit, f"with {_SIDES} select token, count(distinct side) n_sides, count(*) n_rows from t group by token having count(distinct side) > 1"),
    "doc_hash_overlap_benchmark": (doc_hash_overlap_benchmark, """with l as (select doc_id, md5(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) t from (select doc_id, unnest(string_split(text, chr(10))) x from documents))
        select doc_id from documents where doc_id not in (select doc_id from l where t in (select md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) from benchmark))"""),
    "doc_components": (doc_components, f"""with recursive {_SIDES}, h as (select token, min(doc_id) hub from t group by token), e as (select distinct doc_id a, hub b from t join h using (token)),
        ee as (select a, b from e union select b, a from e), r(a, b) as (select doc_id, doc_id from documents union select r.a, ee.b from r join ee on r.b = ee.a) select a doc_id, min(b) component from r group by a"""),
    "emb_hamming_pairs": (emb_hamming_pairs, """with b as (select vec_id, ('0x' || substr(md5((vec_id // 2)::varchar), 1, 8))::bigint h, xor(('0x' || substr(md5((vec_id // 2)::varchar), 9, 8))::bigint, (1::bigint << (vec_id % 7)) - 1) l from embeddings)
        select x.vec_id a, y.vec_id b, (bit_count(xor(x.h, y.h)) + bit_count(xor(x.l, y.l)))::bigint distance from b x join b y on x.vec_id < y.vec_id where bit_count(xor(x.h, y.h)) + bit_count(xor(x.l, y.l)) <= 4"""),
    "doc_vocab_core": (doc_vocab_core, """with w as (select unnest(regexp_extract_all(text, '[A-Za-z]+')) w from documents), s as (select lower(w) norm, w, count(*) c from w group by all), r as (select *, row_number() over (partition by norm order by c desc, w) k, sum(c) over (partition by norm) n from s)
        select norm, n::bigint n, w display from r where k = 1 and n >= 10"""),
    "doc_oov": (doc_oov, """with w as (select doc_id % 5 = 0 test, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) w from documents), k as (select distinct w from w where not test), n as (select lang, w, count(*) c from w where test and w not in (from k) group by all)
        select lang, count(*) n_unique, sum(c)::bigint n_uses from n group by lang"""),
    "event_cache_probe": (event_cache_probe, """with e as (select *, md5(event_type || '|' || floor(value)::bigint::varchar) d from events) select event_type, count(*) n_cached from e where ts >= '2024-01-15' and d in (select d from e where ts < '2024-01-15') group by 1"""),
    "doc_route": (doc_route, "select doc_id, lang, lang worker from documents"),
    "order_gap": (order_gap, """select o_custkey, round(max(o_totalprice) filter (o_orderstatus = 'F') - max(o_totalprice) filter (o_orderstatus = 'O'), 4) gap from orders group by 1 having max(o_totalprice) filter (o_orderstatus = 'F') is not null and max(o_totalprice) filter (o_orderstatus = 'O') is not null"""),
    "doc_left_counts": (doc_left_counts, """select source, count(*) n, count(*) filter (quality is null) n_missing, count(*) filter (quality = 0) n_poor from documents left join labels using (doc_id) group by 1"""),
}
