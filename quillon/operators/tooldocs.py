"""The system prompts that agent formats write for a list of tools.

A format's document is data: how the system prompt stands, a block for each tool, what
joins the blocks, and what follows. Tools are JSON texts, schemas bare or wrapped as
{"type": "function", "function": ...}. JSON within a document is spaced as Python's
writer spaces it, keys in the order they came.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ToolDocument:
    """`before` and `after` may hold {system} and {names}; `each` holds {name}, {human}, {description}, {parameters} and {json}.

    system: 'plain' as it is, 'apart' followed by an empty line unless it is empty, 'last' after the document behind a mark,
    'none' left out; `missing` stands for a null one. schema: what {json} is: 'wrapped', 'bare' or 'given'; indent: its indentation.
    """

    before: str
    each: str
    joint: str
    after: str
    system: str = "plain"
    missing: str = ""
    schema: str = "wrapped"
    indent: int | None = None
    unless_last: str = ""


_SIGNATURES = "You may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>\n"
_XML_CALL = "</tools>\n\nFor each function call, output the function name and arguments within the following XML format:\n"
_QWEN_EN, _QWEN_ZH = "### {human}\n\n{name}: {description} Parameters: {parameters} Format the arguments as a JSON object.", "### {human}\n\n{name}: {description} 输入参数：{parameters} 此工具的输入应为JSON对象。"
_ACCESS_EN, _ACCESS_ZH = "{system}\n\n# Tools\n\n## You have access to the following tools:\n\n", "{system}\n\n# 工具\n\n## 你拥有如下工具：\n\n"
_GLM_EACH = "## {name}\n\n{json}\n在调用上述函数时，请使用 Json 格式表示调用的参数。"
_GLM_TIGHT = "\n" + _XML_CALL + "<tool_call>{function-name}<arg_key>{arg-key-1}</arg_key><arg_value>{arg-value-1}</arg_value><arg_key>{arg-key-2}</arg_key><arg_value>{arg-value-2}</arg_value>...</tool_call>"
# The words of known formats by key.
DOCUMENTS: dict[str, ToolDocument] = {
    "react_en": ToolDocument(
        "Answer the following questions as best you can. You have access to the following tools:\n\n",
        "{name}: Call this tool to interact with the {human} API. What is the {human} API useful for? {description} Parameters: {parameters} Format the arguments as a JSON object.", "\n\n",
        "\n\nUse the following format:\n\nQuestion: the input question you must answer\nThought: you should always think about what to do\nAction: the action to take, should be one of [{names}]\nAction Input: the input to the action\nObservation: the result of the action\n"
        "... (this Thought/Action/Action Input/Observation can be repeated zero or more times)\nThought: I now know the final answer\nFinal Answer: the final answer to the original input question\n\nBegin!\n", "none",
    ),
    "react_zh": ToolDocument(
        "尽可能地回答以下问题。你可以使用以下工具:\n\n", "{name}: 调用此工具与 {human} API 进行交互。{human} 有什么用？{description} 输入参数：{parameters} 此工具的输入应为JSON对象。", "\n\n",
        "\n\n请按照以下格式进行:\n\nQuestion: 需要你回答的输入问题\nThought: 你应该总是思考该做什么\nAction: 需要使用的工具，应该是[{names}]中的一个\nAction Input: 传入工具的内容\nObservation: 行动的结果\n"
        "... (这个Thought/Action/Action Input/Observation可以重复N次)\nThought: 我现在知道最后的答案\nFinal Answer: 对原始输入问题的最终答案\n\n现在开始！\n", "none",
    ),
    "qwen_en": ToolDocument(
        _ACCESS_EN, _QWEN_EN, "\n\n",
        "\n\n## When you need to call a tool, please insert the following command in your reply, which can be called zero or multiple times according to your needs:\n\n✿FUNCTION✿: The tool to use, should be one of [{names}]\n✿ARGS✿: The input of the tool\n✿RESULT✿: Tool results\n"
        "✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)",
    ),
    "qwen_zh": ToolDocument(_ACCESS_ZH, _QWEN_ZH, "\n\n", "\n\n## 你可以在回复中插入零次、一次或多次以下命令以调用工具：\n\n✿FUNCTION✿: 工具名称，必须是[{names}]之一。\n✿ARGS✿: 工具输入\n✿RESULT✿: 工具结果\n✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来"),
    "qwen_en_parallel": ToolDocument(
        _ACCESS_EN, _QWEN_EN, "\n\n",
        "\n\n## Insert the following command in your reply when you need to call N tools in parallel:\n\n✿FUNCTION✿: The name of tool 1, should be one of [{names}]\n✿ARGS✿: The input of tool 1\n✿FUNCTION✿: The name of tool 2\n✿ARGS✿: The input of tool 2\n...\n✿FUNCTION✿: The name of tool N\n"
        "✿ARGS✿: The input of tool N\n✿RESULT✿: The result of tool 1\n✿RESULT✿: The result of tool 2\n...\n✿RESULT✿: he result of tool N\n✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)",
    ),
    "qwen_zh_parallel": ToolDocument(
        _ACCESS_ZH, _QWEN_ZH, "\n\n",
        "\n\n## 你可以在回复中插入以下命令以并行调用N个工具：\n\n✿FUNCTION✿: 工具1的名称，必须是[{names}]之一\n✿ARGS✿: 工具1的输入\n✿FUNCTION✿: 工具2的名称\n✿ARGS✿: 工具2的输入\n...\n✿FUNCTION✿: 工具N的名称\n✿ARGS✿: 工具N的输入\n✿RESULT✿: 工具1的结果\n✿RESULT✿: 工具2的结果\n...\n✿RESULT✿: 工具N的结果\n"
        "✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来",
    ),
    "hermes": ToolDocument(
        "{system}\n\n# Tools\n\n" + _SIGNATURES, "{json}", "\n",
        '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>',
    ),
    "hunyuan_hermes": ToolDocument(
        "{system}# Tools\n\n" + _SIGNATURES, "{json}", "\n",
        "\n</tools>\n\nFor function call returns, you should first print <tool_calls>For each function call, you should return object like:\n<tool_call>function_name\n```json\nfunction_arguments_in_json_format\n```</tool_call>At the end of function call returns, you should print </tool_calls>", "apart",
    ),
    "youtu": ToolDocument(
        "{system}<|begin_of_tool_description|>Tool calling capabilities.\nYou may call one or more functions to assist with the user query. You have the following functions available:\n", "```json\n{json}\n```", "\n",
        '\nFor tool call returns, you MUST use the following format:\n<tool_call>{"name": "function-name", "arguments": {"param1": "value1", "param2": "value2"}}</tool_call>\n<|end_of_tool_description|>', "apart",
    ),
    "mistral": ToolDocument("{system}[AVAILABLE_TOOLS]", "{json}", " ", "[/AVAILABLE_TOOLS]"),
    "toolbench": ToolDocument(
        "You can use many tools(functions) to do the following task.\nFirst I will give you the task description, and your task start.\nAt each step, you need to give your thought to analyze the status now and what to do next, with a function call to actually execute your step. "
        "Your output should follow this format:\nThought:\nAction:\nAction Input:\n\nAfter the call, you will get the call result, and you are now in a new state.\nThen you will analyze your status now, then decide what to do next...\n"
        "After many (Thought-call) pairs, you finally perform the task, then you can give your final answer.\nRemember:\n1.the state change is irreversible, you can't go back to one of the former state, if you want to restart the task, say \"I give up and restart\".\n"
        "2.All the thought is short, at most in 5 sentence.\n3.You can do more then one try, so if your plan is to continuously try some conditions, you can do one of the conditions per try.\nLet's Begin!\n"
        "Task description: You should use functions to help handle the real time user queries. Remember:\n1.ALWAYS call \"Finish\" function at the end of the task. And the final answer should contain enough information to show to the user,If you can't handle the task, "
        "or you find that function calls always fail(the function is not valid now), use function Finish->give_up_and_restart.\n2.Do not use origin tool names, use only subfunctions' names.\nSpecifically, you have access to the following APIs: [",
        "{json}", ", ", "]", "none", schema="bare",
    ),
    "chatglm4": ToolDocument("你是一个名为 GLM-4 的人工智能助手。你是基于智谱AI训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。\n\n# 可用工具\n\n", _GLM_EACH, "\n", "", "none", schema="bare", indent=4),
    "glm4": ToolDocument("# 可用工具\n\n", _GLM_EACH, "\n", "", "none", schema="bare", indent=4),
    "glm4_5": ToolDocument(
        "# Tools\n\n" + _SIGNATURES, "{json}", "\n", "\n" + _XML_CALL + "<tool_call>{function-name}\n<arg_key>{arg-key-1}</arg_key>\n<arg_value>{arg-value-1}</arg_value>\n<arg_key>{arg-key-2}</arg_key>\n<arg_value>{arg-value-2}</arg_value>\n...\n</tool_call>", "last", schema="given"
    ),
    "glm4_7": ToolDocument("# Tools\n\n" + _SIGNATURES, "{json}", "\n", _GLM_TIGHT, "last", schema="given", unless_last="\n"),
    "glm5_1": ToolDocument("# Tools\n\n" + _SIGNATURES, "{json}", "\n", _GLM_TIGHT, "last", schema="bare", unless_last="\n"),
    "qwen3_coder": ToolDocument(
        "{system}\n\n# Tools\n\nYou have access to the following functions:\n\n<tools>\n", "{elements}", "\n",
        "\n</tools>\n\nIf you choose to call a function ONLY reply in the following format with NO suffix:\n\n<tool_call>\n<function=example_function_name>\n<parameter=example_parameter_1>\nvalue_1\n</parameter>\n<parameter=example_parameter_2>\nThis is the value for the second parameter\n"
        "that can span\nmultiple lines\n</parameter>\n</function>\n</tool_call>\n\n<IMPORTANT>\nReminder:\n- Function calls MUST follow the specified format: an inner <function=...></function> block must be nested within <tool_call></tool_call> XML tags\n- Required parameters MUST be specified\n"
        "- You may provide optional reasoning for your function call in natural language BEFORE the function call, but NOT after\n- If there is no function call available, answer the question like normal with your current knowledge and do not tell the user about function calls\n</IMPORTANT>",
        missing="You are Qwen, a helpful AI assistant that can interact with a computer to solve tasks.",
    ),
}
FIELDS = "array<struct<name:string,human:string,description:string,parameters:string,json:string,elements:string>>"


def register(key: str, document: ToolDocument, exist_ok: bool = False) -> None:
    """Add a document of one's own."""
    if key in DOCUMENTS and not exist_ok:
        raise ValueError(f"{key} is registered already")
    DOCUMENTS[key] = document


def _elements(fn: dict) -> str:
    """A schema as elements, walked key by key: known ones first, the others as JSON in elements of their names."""

    def others(value: object, known: tuple[str, ...]) -> list[str]:
        return [f"<{k}>{json.dumps(v, ensure_ascii=False)}</{k}>" for k, v in value.items() if k not in known] if isinstance(value, dict) else []

    lines = ["<function>", f"<name>{fn['name']}</name>"]
    if "description" in fn:
        lines.append(f"<description>{fn['description'].strip()}</description>")
    lines.append("<parameters>")
    schema = fn.get("parameters")
    fields = schema.get("properties") if isinstance(schema, dict) else None
    for name, field in fields.items() if isinstance(fields, dict) else ():
        lines += ["<parameter>", f"<name>{name}</name>"]
        if "type" in field:
            lines.append(f"<type>{field['type']}</type>")
        if "description" in field:
            lines.append(f"<description>{field['description'].strip()}</description>")
        lines += [*others(field, ("name", "type", "description")), "</parameter>"]
    lines += [*others(schema, ("type", "properties")), "</parameters>", *others(fn, ("type", "name", "description", "parameters")), "</function>"]
    return "\n".join(lines)


def _fields(tool: str, schema: str, indent: int | None, elements: bool) -> dict[str, str | None]:
    given = json.loads(tool)
    fn = given["function"] if "type" in given and "function" in given else given
    whole = {"wrapped": given if "type" in given or "function" in given else {"type": "function", "function": given}, "bare": fn, "given": given}[schema]
    name = fn.get("name_for_model") or fn.get("name")
    told = fn.get("description") if fn.get("description") is not None else fn.get("description_for_model")
    needs = fn.get("parameters") or {}
    return {
        "name": str(name), "human": str(fn.get("name_for_human") or name), "description": str(told), "parameters": needs if isinstance(needs, str) else json.dumps(needs, ensure_ascii=False),
        "json": json.dumps(whole, ensure_ascii=False, indent=indent), "elements": _elements(given.get("function", given)) if elements else None,
    }


def _filled(template: str, values: dict[str, Column]) -> Column:
    """A template with its {names} replaced; other braces stay."""
    parts: list[Column] = []
    while template:
        at, key = min(((template.find("{" + k + "}"), k) for k in values if "{" + k + "}" in template), default=(-1, ""))
        if at < 0:
            parts.append(F.lit(template))
            break
        parts += [F.lit(template[:at]), values[key]]
        template = template[at + len(key) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def tool_document(system: Column, tools: Column, key: str) -> Column:
    """The format's system prompt for an array of tools (JSON texts); null or empty without tools is the system prompt itself."""
    doc = DOCUMENTS[key]
    schema, indent, elements = doc.schema, doc.indent, "{elements}" in doc.each

    @F.pandas_udf(FIELDS)
    def read(x: pd.Series) -> pd.Series:
        return x.map(lambda ts: None if ts is None else [_fields(t, schema, indent, elements) for t in ts])

    listed = read(tools)
    given = F.coalesce(system, F.lit(doc.missing))
    shown = {"plain": given, "apart": F.when(given == "", "").otherwise(F.concat(given, F.lit("\n\n"))), "last": F.lit(""), "none": F.lit("")}[doc.system]
    each = F.transform(listed, lambda t: _filled(doc.each, {k: t[k] for k in ("name", "human", "description", "parameters", "json", "elements")}))
    around = {"system": shown, "names": F.array_join(F.transform(listed, lambda t: t["name"]), ",")}
    text = F.concat(_filled(doc.before, around), F.array_join(each, doc.joint), _filled(doc.after, around))
    if doc.system == "last":
        own = F.btrim(given, F.lit(" \t\n\r\x0b\x0c"))
        text = F.when(own != "", F.concat(text, F.lit("<|system|>\n"), own)).otherwise(F.concat(F.lit(doc.unless_last), text))
    return F.when(F.coalesce(F.size(tools), F.lit(0)) < 1, F.coalesce(system, F.lit(""))).otherwise(text)
