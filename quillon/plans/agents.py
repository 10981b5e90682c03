"""Queries of agent formats and record layouts, over parts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents as A
from .common import table


def agent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls written as Hermes and as ReAct, and read back."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("_")).alias("name"), F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit("}")).alias("args"))
    k = F.when(F.col("p_partkey") % 2 == 0, A.format_call(F.col("name"), F.col("args"), "hermes")).otherwise(A.format_call(F.col("name"), F.col("args"), "react_en"))
    c = p.select("p_partkey", k.alias("written")).withColumn("c", A.calls_in(F.col("written")))
    return c.select("p_partkey", "written", F.get("c", 0)["name"].alias("name"), F.regexp_replace(F.get("c", 0)["arguments"], " ", "").alias("arguments"))


def agent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as tool calls, merged where they follow one another after system turns are dropped."""
    t = table(spark, sf_dir, "conversations").filter("role <> 'assistant' or turn % 3 = 0")
    t = t.select("conv_id", "turn", F.when(F.col("role") == "user", "tool_call").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "user", F.concat(F.lit('{"name":"t'), F.col("turn").cast("string"), F.lit('","arguments":"a"}'))).otherwise(F.col("text")).alias("text"))
    return A.merge_tool_calls(t, "conv_id", "turn", "role", "text").filter("role = 'assistant' and text like '<tool_call>%'")


def agent_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas wrapped once, unwrapped in a system prompt."""
    tool = F.concat(F.lit('{"name":"'), F.col("r_name"), F.lit('"}'))
    r = table(spark, sf_dir, "region").select("r_regionkey", A.wrap_tool(A.wrap_tool(tool)).alias("wrapped"))
    return r.select("r_regionkey", "wrapped", A.system_with_tools(F.lit("Be brief."), F.array("wrapped"), "hermes").alias("system"))


def agent_loss_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions count twice, observations not at all."""
    made = F.concat(F.lit("think "), F.col("p_brand"), F.lit("Action:"), F.col("p_name"), F.lit("Observation:"), F.col("p_type"))
    w = A.loss_weights(made, {"Action:": (2.0, 2.0), "Observation:": (2.0, 0.0)})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(w, lambda s: F.concat(s["content"], F.lit("*"), s["scale"].cast("int").cast("string"))), "|").alias("weights"))


def record_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-key records and router rows of parts."""
    p = table(spark, sf_dir, "part")
    rec = A.benchmark_record(p, 2, "naming", F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.array(F.lit("x.png")), F.create_map(F.lit("brand"), F.col("p_brand")))
    a = rec.select("id", F.concat_ws("|", F.col("task_id").cast("string"), "skill", F.col("messages")[0]["content"], F.col("messages")[1]["content"], F.col("metadata")["brand"]).alias("flat"))
    b = A.router_rows(p.withColumn("task", F.col("p_size") % 5), "p_partkey", "task", "p_name").select("id", F.concat_ws("|", "query", "response").alias("flat"))
    return a.unionByName(b)


QUERIES = {
    "agent_calls": (agent_calls, """with p as (select p_partkey, replace(p_brand, '#', '_') n, '{"size": ' || p_size::varchar || '}' a from part)
        select p_partkey, case when p_partkey % 2 = 0 then '<tool_call>' || chr(10) || '{"name": "' || n || '", "arguments": ' || a || '}' || chr(10) || '</tool_call>' else 'Action: ' || n || chr(10) || 'Action Input: ' || a end written, n as name, replace(a, ' ', '') arguments from p"""),
    "agent_merge": (agent_merge, """with t as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) - row_number() over (partition by conv_id, role order by turn) g from conversations where role <> 'assistant' or turn % 3 = 0)
        select conv_id, min(turn) turn, 'assistant' as role, string_agg('<tool_call>' || chr(10) || '{"name": "t' || turn::varchar || '", "arguments": a}' || chr(10) || '</tool_call>', chr(10) order by turn) as text from t where role = 'user' group by conv_id, g"""),
    "agent_tools": (agent_tools, """select r_regionkey, '{"type":"function","function":{"name":"' || r_name || '"}}' wrapped, 'Be brief.' || chr(10) || chr(10) || '<tools>' || chr(10) || '{"name":"' || r_name || '"}' || chr(10) || '</tools>' as system from region"""),
    "agent_loss_weights": (agent_loss_weights, "select p_partkey, 'think ' || p_brand || '*1|Action:*2|' || p_name || '*2|Observation:*2|' || p_type || '*0' weights from part"),
    "record_layout": (record_layout, """select p_partkey::varchar id, '2|naming|' || p_name || '|' || p_type || '|' || p_brand flat from part union all select 'router-' || p_partkey::varchar, 'Choose the expert for this question.' || chr(10) || p_name || '|EXPERT_' || (p_size % 5)::varchar from part"""),
}
