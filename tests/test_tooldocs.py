"""System prompts with tools against fixed strings."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import tooldocs as D

WEATHER = {
    "name": "weather", "description": " Weather of a city. ", "strict": True,
    "parameters": {"type": "object", "properties": {"city": {"type": "string", "description": "Its name "}, "unit": {"type": "string", "enum": ["c", "f"]}}, "required": ["city"]},
}
NOW = {"type": "function", "function": {"name": "now", "description": "Zeit: jetzt", "parameters": {}}}
W_JSON = '{"name": "weather", "description": " Weather of a city. ", "strict": true, "parameters": {"type": "object", "properties": {"city": {"type": "string", "description": "Its name "}, "unit": {"type": "string", "enum": ["c", "f"]}}, "required": ["city"]}}'
W_PAR = '{"type": "object", "properties": {"city": {"type": "string", "description": "Its name "}, "unit": {"type": "string", "enum": ["c", "f"]}}, "required": ["city"]}'
N_JSON = '{"type": "function", "function": {"name": "now", "description": "Zeit: jetzt", "parameters": {}}}'
# What the formats write for the system prompt "Be brief." and these two tools.
FIXED = {
    "hermes": f"""Be brief.

# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{{"type": "function", "function": {W_JSON}}}
{N_JSON}
</tools>

For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:
<tool_call>
{{"name": <function-name>, "arguments": <args-json-object>}}
</tool_call>""",
    "hunyuan_hermes": f"""Be brief.

# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{{"type": "function", "function": {W_JSON}}}
{N_JSON}
</tools>

For function call returns, you should first print <tool_calls>For each function call, you should return object like:
<tool_call>function_name
```json
function_arguments_in_json_format
```</tool_call>At the end of function call returns, you should print </tool_calls>""",
    "react_en": f"""Answer the following questions as best you can. You have access to the following tools:

weather: Call this tool to interact with the weather API. What is the weather API useful for?  Weather of a city.  Parameters: {W_PAR} Format the arguments as a JSON object.

now: Call this tool to interact with the now API. What is the now API useful for? Zeit: jetzt Parameters: {{}} Format the arguments as a JSON object.

Use the following format:

Question: the input question you must answer
Thought: you should always think about what to do
Action: the action to take, should be one of [weather,now]
Action Input: the input to the action
Observation: the result of the action
... (this Thought/Action/Action Input/Observation can be repeated zero or more times)
Thought: I now know the final answer
Final Answer: the final answer to the original input question

Begin!
""",
    "mistral": f'Be brief.[AVAILABLE_TOOLS]{{"type": "function", "function": {W_JSON}}} {N_JSON}[/AVAILABLE_TOOLS]',
    "glm4": "# 可用工具\n\n## weather\n\n" + json.dumps(WEATHER, indent=4) + "\n在调用上述函数时，请使用 Json 格式表示调用的参数。\n## now\n\n" + '{\n    "name": "now",\n    "description": "Zeit: jetzt",\n    "parameters": {}\n}\n在调用上述函数时，请使用 Json 格式表示调用的参数。',
    "qwen_zh": f"""Be brief.

# 工具

## 你拥有如下工具：

### weather

weather:  Weather of a city.  输入参数：{W_PAR} 此工具的输入应为JSON对象。

### now

now: Zeit: jetzt 输入参数：{{}} 此工具的输入应为JSON对象。

## 你可以在回复中插入零次、一次或多次以下命令以调用工具：

✿FUNCTION✿: 工具名称，必须是[weather,now]之一。
✿ARGS✿: 工具输入
✿RESULT✿: 工具结果
✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来""",
    "glm5_1": f"""# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{W_JSON}
{{"name": "now", "description": "Zeit: jetzt", "parameters": {{}}}}
</tools>

For each function call, output the function name and arguments within the following XML format:
<tool_call>{{function-name}}<arg_key>{{arg-key-1}}</arg_key><arg_value>{{arg-value-1}}</arg_value><arg_key>{{arg-key-2}}</arg_key><arg_value>{{arg-value-2}}</arg_value>...</tool_call><|system|>
Be brief.""",
}
CODER = """Be brief.

# Tools

You have access to the following functions:

<tools>
<function>
<name>weather</name>
<description>Weather of a city.</description>
<parameters>
<parameter>
<name>city</name>
<type>string</type>
<description>Its name</description>
</parameter>
<parameter>
<name>unit</name>
<type>string</type>
<enum>["c", "f"]</enum>
</parameter>
<required>["city"]</required>
</parameters>
<strict>true</strict>
</function>
<function>
<name>now</name>
<description>Zeit: jetzt</description>
<parameters>
</parameters>
</function>
</tools>

If you choose to call a function ONLY reply in the following format with NO suffix:
"""


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([("Be brief.", [json.dumps(WEATHER), json.dumps(NOW)])], "system string, tools array<string>")


def test_documents_equal_fixed_strings(row):
    for key, text in FIXED.items():
        assert row.select(D.tool_document(F.col("system"), F.col("tools"), key)).first()[0] == text, key
    assert row.select(D.tool_document(F.col("system"), F.col("tools"), "qwen3_coder")).first()[0].startswith(CODER)


def test_all_documents_name_all_tools_and_bear_nulls(spark):
    d = spark.createDataFrame([(None, [json.dumps(WEATHER)]), ("", [json.dumps(WEATHER)]), ("S", None), (None, [])], "system string, tools array<string>")
    for key in D.DOCUMENTS:
        a, b, c, e = (r[0] for r in d.select(D.tool_document(F.col("system"), F.col("tools"), key)).collect())
        assert "weather" in a and "weather" in b and c == "S" and e == "" and "{system}" not in a and "{json}" not in a
    own = D.ToolDocument("[{system}|{names}]", "{name}", "/", "!", schema="bare")
    D.register("own", own)
    assert d.select(D.tool_document(F.lit("x"), F.col("tools"), "own")).first()[0] == "[x|weather]weather!"
    with pytest.raises(ValueError):
        D.register("own", own)
    del D.DOCUMENTS["own"]
