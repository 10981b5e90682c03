"""Agent prompts: tool schemas, system layouts as data, tool calls out of and into text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Layout:
    """How a format spells calls and results.

    A call is `call[0]`, the name, `call[1]`, the arguments, `call[2]`; with `json_object` it is one JSON object between
    call[0] and call[2]. Arguments are JSON, or with `param` one `param[0] key param[1] value param[2]` each.
    """

    call: tuple[str, str, str]
    result: tuple[str, str] = ("", "")
    json_object: bool = False
    param: tuple[str, str, str] | None = None
    block: tuple[str, str] = ("", "")
    between: str = "\n"
    tools: tuple[str, str] = ("", "")
    arguments_key: str = "arguments"


_TOOLS = ("<tools>\n", "\n</tools>")
_REACT = Layout(("Action: ", "\nAction Input: ", ""), ("Observation: ", ""))
_REACT_ZH = Layout(("行动: ", "\n行动输入: ", ""), ("观察: ", ""))
_QWEN = Layout(("✿FUNCTION✿: ", "\n✿ARGS✿: ", ""), ("✿RESULT✿: ", ""))
_HERMES = Layout(("<tool_call>\n", "", "\n</tool_call>"), ("<tool_response>\n", "\n</tool_response>"), True, tools=_TOOLS)
_XML = Layout(("<tool_call>\n<function=", ">\n", "\n</function>\n</tool_call>"), ("<tool_response>\n", "\n</tool_response>"), param=("<parameter=", ">\n", "\n</parameter>"), tools=_TOOLS)
_GLM4 = Layout(("", "\n", ""), ("", ""), between="<|assistant|>", block=("", "<|observation|>"))
_KEYS = Layout(("<tool_call>", "\n", "\n</tool_call>"), ("<tool_response>\n", "\n</tool_response>"), param=("<arg_key>", "</arg_key>\n<arg_value>", "</arg_value>"), tools=_TOOLS)
_KEYS_TIGHT = Layout(("<tool_call>", "", "</tool_call>"), ("<tool_response>", "</tool_response>"), param=("<arg_key>", "</arg_key><arg_value>", "</arg_value>"), between="", tools=_TOOLS)
_HY = Layout(("<tool_call>", "<tool_sep>\n", "\n</tool_call>"), ("<tool_response>\n", "\n</tool_response>"), param=("<arg_key>", "</arg_key>\n<arg_value>", "</arg_value>"), block=("<tool_calls>\n", "\n</tool_calls>"), tools=_TOOLS)
_INVOKE = Layout(('<invoke name="', '">\n', "\n</invoke>"), ("<response>", "</response>"), param=('<parameter name="', '">', "</parameter>"), block=("<minimax:tool_call>\n", "\n</minimax:tool_call>"), tools=_TOOLS)
# The marks of known formats by key; formats that share marks share a layout.
LAYOUTS: dict[str, Layout] = {
    "react_en": _REACT, "react_zh": _REACT_ZH, "react_grpo": _REACT, "toolbench": _REACT,
    "qwen_en": _QWEN, "qwen_zh": _QWEN, "qwen_en_parallel": _QWEN, "qwen_zh_parallel": _QWEN,
    "qwen3_coder": _XML, "qwen3_5": _XML,
    "hermes": _HERMES, "hunyuan_hermes": _HERMES, "youtu": _HERMES,
    "hy_v3_preview": _HY, "hy_v3": _HY,
    "chatglm4": _GLM4, "glm4": _GLM4, "glm4_5": _KEYS, "glm4_7": _KEYS_TIGHT, "glm5_1": _KEYS_TIGHT,
    "llama3": Layout(("", "", ""), json_object=True, arguments_key="parameters"), "llama4": Layout(("", "", ""), json_object=True, block=("", "<|eom|>"), arguments_key="parameters"),
    "deepseek_v3_1": Layout(("<｜tool▁call▁begin｜>", "<｜tool▁sep｜>", "<｜tool▁call▁end｜>"), ("<｜tool▁output▁begin｜>", "<｜tool▁output▁end｜>"), block=("<｜tool▁calls▁begin｜>", "<｜tool▁calls▁end｜>"), between=""),
    "deepseek_v4": Layout(('<｜DSML｜invoke name="', '">\n', "\n</｜DSML｜invoke>"), ("<tool_result>", "</tool_result>"), param=('<｜DSML｜parameter name="', '" string="true">', "</｜DSML｜parameter>"), block=("<｜DSML｜tool_calls>\n", "\n</｜DSML｜tool_calls>")),
    "minimax_m2": _INVOKE, "minimax_m3": _INVOKE,
    "seed_oss": Layout(("<seed:tool_call>\n<function=", ">\n", "\n</function>\n</seed:tool_call>"), ("<seed:bos>tool\n", "<seed:eos>"), param=("<parameter=", ">", "</parameter>")),
    "gemma4": Layout(("<|tool_call>call:", "", "<tool_call|>"), ("<|tool_response>response:", "<tool_response|>"), between=""),
    "mistral": Layout(("", "", ""), ("[TOOL_RESULTS]", "[/TOOL_RESULTS]"), True, block=("[TOOL_CALLS][\n", "\n]</s>"), tools=("[AVAILABLE_TOOLS][", "][/AVAILABLE_TOOLS]")),
    "kimi_k25": Layout(("<|tool_call_begin|>", "<|tool_call_argument_begin|>", "<|tool_call_end|>"), ("<|im_system|>tool<|im_middle|>", "<|im_end|>"), block=("<|tool_calls_section_begin|>", "<|tool_calls_section_end|>"), between=""),
    "minicpm5": Layout(('<function name="', '">', "</function>"), ("<tool_response>\n", "\n</tool_response>"), param=('<param name="', '">', "</param>"), tools=_TOOLS),
}


def register(key: str, layout: Layout, exist_ok: bool = False) -> None:
    """Add a format of one's own."""
    if key in LAYOUTS and not exist_ok:
        raise ValueError(f"{key} is registered already")
    LAYOUTS[key] = layout


def wrap_tool(tool: Column) -> Column:
    """A tool's JSON as `{"type": "function", "function": ...}`, once."""
    return F.when(F.get_json_object(tool, "$.function").isNotNull(), tool).otherwise(F.concat(F.lit('{"type":"function","function":'), tool, F.lit("}")))


def unwrap_tool(tool: Column) -> Column:
    return F.coalesce(F.get_json_object(tool, "$.function"), tool)


def format_call(name: Column, arguments: Column, key: str) -> Column:
    """One call as the format writes it; arguments are JSON."""
    la = LAYOUTS[key]
    if la.json_object:
        body = F.concat(F.lit('{"name": "'), name, F.lit(f'", "{la.arguments_key}": '), arguments, F.lit("}"))
        return F.concat(F.lit(la.call[0]), body, F.lit(la.call[2]))
    if la.param:
        each = F.transform(F.map_entries(F.from_json(arguments, "map<string,string>")), lambda e: F.concat(F.lit(la.param[0]), e["key"], F.lit(la.param[1]), F.coalesce(e["value"], F.lit("null")), F.lit(la.param[2])))
        arguments = F.array_join(each, "\n" if "\n" in la.call[1] else "")
    return F.concat(F.lit(la.call[0]), name, F.lit(la.call[1]), arguments, F.lit(la.call[2]))


def format_calls(calls: Column, key: str) -> Column:
    """All calls (array<struct<name, arguments>>) of a turn, within the format's block."""
    la = LAYOUTS[key]
    return F.concat(F.lit(la.block[0]), F.array_join(F.transform(calls, lambda c: format_call(c["name"], c["arguments"], key)), la.between), F.lit(la.block[1]))


def parse_calls(text: Column, key: str) -> Column:
    """array<struct<name, arguments>> of a text in the format; arguments as JSON (values of parameters as strings)."""
    return T.let(text, lambda t: _parsed(t, LAYOUTS[key]))


def shared_layouts() -> list[list[str]]:
    """The registered formats by layout, each in order: those of one layout write and read alike."""
    found: dict[Layout, list[str]] = {}
    for key in sorted(LAYOUTS):
        found.setdefault(LAYOUTS[key], []).append(key)
    return list(found.values())


def _parsed(text: Column, la: Layout) -> Column:
    if la.json_object:
        inner = F.regexp_extract_all(text, F.lit(rf'(?s)(\{{"name": "[^"]*", "{la.arguments_key}": \{{.*?\}}\}})'), F.lit(1))
        return F.transform(inner, lambda j: F.struct(F.get_json_object(j, "$.name").alias("name"), F.get_json_object(j, f"$.{la.arguments_key}").alias("arguments")))
    body = F.substring(text, len(la.block[0]) + 1, 1 << 30) if la.block[0] else text
    body = F.regexp_replace(body, re.escape(la.block[1]) + "$", "") if la.block[1] else body
    end = re.escape(la.call[2]) if la.call[2] else f"(?:{re.escape(la.between)}|$)" if la.call[0] == "" else f"(?=\\s*{re.escape(la.call[0])}|$)"
    head = re.escape(la.call[1]) if la.call[1] else r"(?=[{<])"
    pattern = rf"(?s){re.escape(la.call[0])}([^\n{{<]*?){head}(.*?){end}"
    both = T.let(body, lambda b: F.arrays_zip(F.regexp_extract_all(b, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(b, F.lit(pattern), F.lit(2)).alias("arguments")))
    if not la.param:
        return F.filter(F.transform(both, lambda c: F.struct(F.trim(c["name"]).alias("name"), F.trim(c["arguments"]).alias("arguments"))), lambda c: c["name"] != "")
    one = rf"(?s){re.escape(la.param[0])}(.*?){re.escape(la.param[1])}(.*?){re.escape(la.param[2])}"
    args = lambda a: F.to_json(F.map_from_arrays(F.regexp_extract_all(a, F.lit(one), F.lit(1)), F.regexp_extract_all(a, F.lit(one), F.lit(2))))
    return F.transform(both, lambda c: F.struct(c["name"].alias("name"), args(c["arguments"]).alias("arguments")))


def format_results(results: Column, key: str) -> Column:
    la = LAYOUTS[key]
    return F.array_join(F.transform(results, lambda r: F.concat(F.lit(la.result[0]), r, F.lit(la.result[1]))), "\n")


def system_with_tools(system: Column, tools: Column, key: str) -> Column:
    """The system prompt with the tools' schemas, one a line, between the format's marks."""
    la = LAYOUTS[key]
    return F.concat(F.coalesce(system, F.lit("")), F.lit("\n\n" + la.tools[0]), F.array_join(F.transform(tools, unwrap_tool), "\n"), F.lit(la.tools[1]))


def calls_in(text: Column) -> Column:
    """array<struct<name, arguments>>: tagged JSON calls, else the last action."""
    tagged = T.tool_calls(text)
    act = T.last_action(text)
    one = F.array(F.struct(act["action"].alias("name"), act["input"].alias("arguments")))
    return F.when(F.size(tagged) > 0, tagged).when(F.contains(text, F.lit("Action:")), one).otherwise(F.array().cast("array<struct<name:string,arguments:string>>"))


def merge_tool_calls(turns: DataFrame, key: str, order: str, role: str, text: str, layout: str = "hermes") -> DataFrame:
    """Runs of `tool_call` turns become one assistant turn in the format's spelling; other turns stay."""
    w = W.partitionBy(key).orderBy(order)
    same = F.lag(role).over(w).eqNullSafe(F.col(role)) & (F.col(role) == "tool_call")
    island = turns.withColumn("_i", F.sum(F.when(same, 0).otherwise(1)).over(w))
    body = F.when(F.col(role) == "tool_call", format_call(F.get_json_object(text, "$.name"), F.coalesce(F.get_json_object(text, "$.arguments"), F.lit("{}")), layout)).otherwise(F.col(text))
    out = island.withColumn("_t", body).groupBy(key, "_i", role).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_t").alias("t")))).alias("_l"), F.min(order).alias(order))
    return out.select(key, order, F.when(F.col(role) == "tool_call", "assistant").otherwise(F.col(role)).alias(role), F.array_join(F.transform("_l", lambda x: x["t"]), "\n").alias(text))


def loss_weights(text: Column, weights: dict[str, tuple[float, float]]) -> Column:
    """array<struct<content, scale>>: a text cut at delimiters; weights gives (delimiter's, following text's) scale, 1 elsewhere."""
    parts = T.split_by(text, list(weights))
    pick = lambda k, i: F.coalesce(*[F.when(k == d, F.lit(float(v[i]))) for d, v in weights.items()], F.lit(1.0))
    return F.filter(F.flatten(F.transform(parts, lambda p: F.array(F.struct(p["key"].alias("content"), pick(p["key"], 0).alias("scale")), F.struct(p["content"].alias("content"), pick(p["key"], 1).alias("scale"))))), lambda s: s["content"] != "")


def benchmark_record(df: DataFrame, task_id: int, skill: str, key: Column, question: Column, answer: Column, images: Column, metadata: Column) -> DataFrame:
    """The six-key record of a benchmark."""
    messages = F.array(F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return df.select(key.cast("string").alias("id"), F.lit(task_id).alias("task_id"), F.lit(skill).alias("skill"), messages.alias("messages"), images.alias("images"), metadata.alias("metadata"))


def router_rows(df: DataFrame, key: str, task: str, question: str) -> DataFrame:
    """Rows that train a router: which expert does a question belong to."""
    return df.select(
        F.concat(F.lit("router-"), F.col(key).cast("string")).alias("id"), F.concat(F.lit("Choose the expert for this question.\n"), F.col(question)).alias("query"), F.concat(F.lit("EXPERT_"), F.col(task).cast("string")).alias("response")
    )
