"""The first end-to-end query: canonical conversations, role filter, stratified hash sample, length statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conversation import has_system, to_messages, valid_messages
from ..operators.sampling import hash_order, spread_rank

SHARE = 0.5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stratum (with or without a system turn): conversations, sampled half by hash order, and their lengths."""
    conv = to_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")).filter(valid_messages(F.col("messages")))
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    base = conv.select("conv_id", has_system(F.col("messages")).alias("with_system"), chars.alias("chars"), F.size("messages").cast("long").alias("turns"))
    ranked = spread_rank(base.withColumn("_h", hash_order(42, "flagship", F.col("conv_id"))), ["with_system"], "_h", ["conv_id"], "rn")
    sizes = base.groupBy("with_system").agg(F.count("*").alias("n"))  # two rows
    kept = ranked.join(F.broadcast(sizes), "with_system").filter(F.col("rn") <= F.ceil(F.col("n") * SHARE))
    return kept.groupBy("with_system").agg(
        F.count("*").alias("n_conversations"), F.sum("turns").alias("n_turns"), F.sum("chars").alias("n_chars"),
        F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"),
    )


SQL = """
with conv as (
  select conv_id, bool_or(role = 'system') with_system, sum(length(text))::bigint chars, count(*) turns
  from conversations group by conv_id
  having bool_and(role in ('system','user','assistant','tool','tool_call','tool_response') and text is not null)
), ranked as (
  select *, row_number() over (partition by with_system order by sha256('42|flagship|' || conv_id::varchar), conv_id) rn,
         count(*) over (partition by with_system) n
  from conv
)
select with_system, count(*) n_conversations, sum(turns)::bigint n_turns, sum(chars)::bigint n_chars,
       min(chars) min_chars, max(chars) max_chars
from ranked where rn <= ceil(n * 0.5) group by with_system
"""
