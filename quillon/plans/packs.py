"""Queries of the packing operators over documents; a document's length is its characters over 4, a shard is 500 ids, so its size is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packing as P
from .common import table

BUDGET = 2048


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 500).alias("shard"), F.ceil(F.col("n_chars") / 4).alias("len"))


def doc_pack_next_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs in document order."""
    return P.next_fit(_docs(spark, sf_dir), "shard", "doc_id", "len", BUDGET)


def doc_next_fit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of all documents in one order, without shards."""
    return P.next_fit_order(_docs(spark, sf_dir).select("doc_id", "len"), ["doc_id"], "len", BUDGET)


def doc_pack_bfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best fit decreasing in chunks of 50."""
    return P.best_fit_shards(_docs(spark, sf_dir), "shard", "doc_id", "len", BUDGET, 50)


def doc_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next-fit packs as rows."""
    r = P.packed_rows(doc_pack_next_fit(spark, sf_dir), ["shard", "pack"], "doc_id", "len")
    return r.select("shard", "pack", "total", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def doc_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dropped while that brings a shard nearer to 20,000."""
    return P.rebalance(_docs(spark, sf_dir), "shard", "doc_id", "len", 20_000)


def doc_length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8 from megabatches of 64."""
    return P.length_batches(_docs(spark, sf_dir), "doc_id", "len", 8, 8).select("doc_id", "mega", "batch")


def doc_cached_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept by the greatest of several lengths."""
    d = _docs(spark, sf_dir).withColumn("lengths", F.array("len", F.floor(F.col("len") / 2)))
    return d.filter(F.array_max("lengths") <= 1000).select("doc_id")


_N = """d as (select doc_id, doc_id // 500 shard, ceil(n_chars / 4.0)::bigint len, row_number() over (partition by doc_id // 500 order by doc_id) i from documents),
  r as (select shard, doc_id, len, i, 0::bigint pack, case when len >= 2048 then 0 else len end used, len >= 2048 full_ from d where i = 1
    union all select d.shard, d.doc_id, d.len, d.i, r.pack + case when r.full_ or (r.used > 0 and r.used + d.len > 2048) then 1 else 0 end,
      case when (case when r.full_ or r.used + d.len > 2048 then d.len else r.used + d.len end) >= 2048 then 0 else (case when r.full_ or (r.used > 0 and r.used + d.len > 2048) then d.len else r.used + d.len end) end,
      (case when r.full_ or (r.used > 0 and r.used + d.len > 2048) then d.len else r.used + d.len end) >= 2048
    from r join d on d.shard = r.shard and d.i = r.i + 1)"""
_WHOLE = """with recursive d as (select doc_id, ceil(n_chars / 4.0)::bigint len, row_number() over (order by doc_id) i from documents),
  r as (select doc_id, len, i, 0::bigint pack, len used from d where i = 1
    union all select d.doc_id, d.len, d.i, case when r.used >= 2048 or r.used + d.len > 2048 then r.pack + 1 else r.pack end, case when r.used >= 2048 or r.used + d.len > 2048 then d.len else r.used + d.len end from r join d on d.i = r.i + 1)"""
QUERIES = {
    "doc_next_fit_order": (doc_next_fit_order, f"{_WHOLE} select doc_id, len, pack from r"),
    "doc_pack_next_fit": (doc_pack_next_fit, f"with recursive {_N} select shard, doc_id, len, pack from r"),
    "doc_pack_bfd": (doc_pack_bfd, None),
    "doc_packed_rows": (doc_packed_rows, f"with recursive {_N} select shard, pack, sum(len)::bigint total, string_agg(doc_id::varchar, ',' order by doc_id) members from r group by all"),
    "doc_rebalance": (doc_rebalance, """with recursive d as (select doc_id, doc_id // 500 shard, ceil(n_chars / 4.0)::bigint len, row_number() over (partition by doc_id // 500 order by doc_id) i from documents), t as (select shard, sum(len)::bigint t from d group by 1),
        r as (select shard, 0::bigint i, t, null::bigint doc_id, null::bigint len, true dropped from t union all select r.shard, d.i, case when abs(r.t - d.len - 20000) < abs(r.t - 20000) then r.t - d.len else r.t end, d.doc_id, d.len, abs(r.t - d.len - 20000) < abs(r.t - 20000) from r join d on d.shard = r.shard and d.i = r.i + 1)
        select shard, doc_id, len from r where not dropped"""),
    "doc_length_batches": (doc_length_batches, """with r as (select doc_id, ceil(n_chars / 4.0) len, (row_number() over (order by sha256('42|length|' || doc_id::varchar), doc_id) - 1) // 64 mega from documents) select doc_id, mega, (row_number() over (partition by mega order by len desc, doc_id) - 1) // 8 as batch from r"""),
    "doc_cached_filter": (doc_cached_filter, "select doc_id from documents where ceil(n_chars / 4.0) <= 1000"),
}
