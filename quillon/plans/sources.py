"""Queries of sources and normalisation. JSON lines are made from the tables, so every query reads the given tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize as N
from ..operators.conversation import to_messages
from ..sources import readers as R
from .common import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of JSON in seven files; every ninth is blank, the last of file 3 is torn."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    js = F.to_json(F.struct("c_custkey", "c_name"))
    last = c.filter(k % 7 == 3).agg(F.max("c_custkey").alias("m"))
    marked = c.crossJoin(F.broadcast(last))  # one row
    return marked.select((k % 7).cast("string").alias("file"), k.alias("line"), F.when(k == F.col("m"), F.lit('{"c_custkey": 1')).when(k % 9 == 0, F.lit("  ")).otherwise(js).alias("value"))


def source_strict_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed lines, the broken one kept aside."""
    p = R.parse_strict(_lines(spark, sf_dir), "c_custkey long, c_name string", fail=False)
    return p.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.col("row").isNull().cast("long")).alias("n_bad"), F.sum("row.c_custkey").alias("key_sum"))


def source_torn_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken last line is dropped."""
    return R.parse_torn(_lines(spark, sf_dir), "c_custkey long, c_name string").select("file", "line", "row.c_name")


def source_line_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: digests of untouched lines (page markup as lines)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("value"))
    return R.with_digest(p).select("page_id", "record_sha256")


def source_union_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as one table with nulls."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return R.union_ragged([s, c])


def norm_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases renamed where they are alone; two claims on `response` leave both."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("Question"), F.col("p_brand").alias("answer"), F.col("p_type").alias("output"), F.col("p_partkey").alias("label"))
    return N.rename_safely(p, N.alias_table())


def norm_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad conversations by reason, good ones counted too."""
    conv = to_messages(table(spark, sf_dir, "conversations"))
    m = F.col("messages")
    why = F.when(F.size(m) < 2, "short").when(N.mentions_any(m, ["token", "mail"]), "mentions").when(~F.exists(m, lambda x: x["role"] == "assistant"), "no_answer")
    good, bad = N.split_bad(conv, why)
    return bad.groupBy("reason").agg(F.count("*").alias("n")).unionByName(good.agg(F.lit("good").alias("reason"), F.count("*").alias("n")))


def norm_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third rejected answer is missing, every third equals the answer."""
    conv = to_messages(table(spark, sf_dir, "conversations"))
    m = F.col("messages")
    r = F.when(F.col("conv_id") % 3 == 0, F.lit(None)).when(F.col("conv_id") % 3 == 1, F.get(m, F.size(m) - 1)["content"]).otherwise(F.lit("no"))
    return conv.select("conv_id", N.rejected_reason(m, r).alias("reason"))


def norm_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages allowed, one source denied, fields complete, flags null-safely equal."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ok = F.col("lang").isin("de", "fr") & (F.col("source") != "src3") & N.complete(F.col("text")) & N.null_safe_all([(F.col("toxic"), None)])
    return d.filter(ok).select("doc_id", F.lit("documents").alias("dataset"))


def norm_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with more than one link target."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", N.distinct_captures(F.col("html"), r"<([a-z0-9]+)", 3).alias("many"))


def norm_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address as a list of media."""
    p = table(spark, sf_dir, "pages")
    m = N.as_media(F.when(F.col("page_id") % 4 != 0, F.col("url")), False)
    return p.select("page_id", F.coalesce(F.size(m), F.lit(0)).cast("long").alias("n"), F.get(m, 0)["path"].alias("path"))


_K = "k as (select c_custkey k, c_name, c_custkey % 7 f, (select max(c_custkey) from customer where c_custkey % 7 = 3) m from customer)"
QUERIES = {
    "source_strict_jsonl": (source_strict_jsonl, f"with {_K} select f::varchar file, count(*) n, count(*) filter (k = m) n_bad, (sum(k) filter (k <> m))::bigint key_sum from k where k = m or k % 9 <> 0 group by f"),
    "source_torn_jsonl": (source_torn_jsonl, f"with {_K} select f::varchar file, k line, c_name from k where k <> m and k % 9 <> 0"),
    "source_line_digests": (source_line_digests, "select page_id, sha256(html) record_sha256 from pages"),
    "source_union_ragged": (source_union_ragged, "select s_suppkey as key, s_name as name, s_acctbal balance, null segment from supplier union all select c_custkey, c_name, null, c_mktsegment from customer"),
    "norm_rename": (norm_rename, "select p_name query, p_brand answer, p_type as output, p_partkey as label from part"),
    "norm_quarantine": (norm_quarantine, """with c as (select conv_id, case when count(*) < 2 then 'short' when bool_or(regexp_matches(lower(text), 'token|mail')) then 'mentions' when not bool_or(role = 'assistant') then 'no_answer' else 'good' end reason from conversations group by 1)
        select reason, count(*) n from c group by 1"""),
    "norm_rejected": (norm_rejected, "select distinct conv_id, case conv_id % 3 when 0 then 'null' when 1 then 'same' end reason from conversations"),
    "norm_eligible": (norm_eligible, "select doc_id, 'documents' dataset from documents left join labels using (doc_id) where lang in ('de', 'fr') and source <> 'src3' and trim(coalesce(text, '')) <> '' and toxic is null"),
    "norm_captures": (norm_captures, "select page_id, len(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1))) > 3 many from pages"),
    "norm_media": (norm_media, "select page_id, (page_id % 4 <> 0)::bigint n, case when page_id % 4 <> 0 then url end path from pages"),
}
