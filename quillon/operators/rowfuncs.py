"""Row functions of known dataset shapes: each takes a DataFrame with that shape's columns and returns canonical rows.

Random choices of an original are hash choices here. Rows that a function refuses are filtered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import lenient
from ..functions.text import split_by
from .conversation import alpaca_query
from .normalize import as_media

FUNCTIONS: dict[str, Callable[..., DataFrame]] = {}


def rowfunc(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    FUNCTIONS[f.__name__] = f
    return f


def say(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def pair(query: Column, response: Column) -> Column:
    """A user turn and an assistant turn."""
    return F.array(say("user", query), say("assistant", response))


def ask(query: Column) -> Column:
    return F.array(say("user", query))


def choose(options: Column | list[str], *keys: str) -> Column:
    """One of the options by a hash of the row's keys."""
    arr = F.array(*map(F.lit, options)) if isinstance(options, list) else options
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *keys).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.element_at(arr, (number % F.size(arr) + 1).cast("int"))


def _keep(df: DataFrame, messages: Column, *extra: Column) -> DataFrame:
    return df.select(messages.alias("messages"), *extra)


# Prompts that must be spelt as they are known.
ADVERT = "Task: Generating advertisements based on keywords.\nKeywords: {{QUERY}}\nAdvertisements:"
CLS_PAIR = "Task: {{TASK}}\nSentence1: {{A}}\nSentence2: {{B}}\nCategory: {{LABELS}}\nOutput:"
CLS_ONE = "Task: {{TASK}}\nSentence: {{A}}\nCategory: {{LABELS}}\nOutput:"
STS = "Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.\nSentence 1: {{A}}\nSentence 2: {{B}}\nSimilarity score: "
HC3 = "Classification Task: Are the following responses from a human or from ChatGPT?\nQuestion: {{A}}\nAnswer: {{B}}\nCategory: Human, ChatGPT\nOutput:"
DUREADER = "Task: Question Generation\nContext: {{A}}\nAnswer: {{B}}\nQuestion:"
SUDOKU = "Solve the following 9x9 Sudoku puzzle. Empty cells are marked with '0'. Provide the completed grid as your answer.\n\nPuzzle:\n"
COUNTDOWN = (
    "Using the numbers {{A}}, create an equation that equals {{B}}.\nYou can use basic arithmetic operations (+, -, *, /) and each number can only be used once.\n"
    "Show your work in <think> </think> tags. And return the final equation and answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 * 4 = 4 </answer>."
)
DOLLY = "Here gives some useful information:\n"
REF = "<ref-object><bbox>"
FIREFLY_KINDS = (
    "ProseGeneration", "MRC", "JinYongGeneration", "TextCorrection", "ClassicalChinese", "BELLE", "StoryGeneration", "Couplet", "Cot", "Dictionary", "Translation", "Program",
    "SentimentAnalyze", "OpenQA", "AncientPoem", "TextMatching", "NLI", "Summary", "KeywordRecognition", "ProductDesc", "LyricGeneration", "Composition", "MusicComment", "NER",
)


def put(template: str, **values: Column) -> Column:
    c = F.lit(template)
    for k, v in values.items():
        c = F.replace(c, F.lit("{{" + k + "}}"), v)
    return c


@rowfunc
def alpaca_zh(df: DataFrame) -> DataFrame:
    """The input's leading mark removed."""
    extra = F.regexp_replace("input", "^输入：", "")
    return _keep(df, pair(alpaca_query(F.col("instruction"), extra), F.col("output")))


@rowfunc
def long_alpaca(df: DataFrame) -> DataFrame:
    """A leading `Answer: ` removed from the response."""
    r = F.when(F.startswith("output", F.lit("Answer: ")), F.trim(F.substr("output", F.lit(9)))).otherwise(F.col("output"))
    return _keep(df, pair(alpaca_query(F.col("instruction"), F.col("input")), r))


@rowfunc
def titles(df: DataFrame) -> DataFrame:
    """Title and different abstract joined, a leading list number dropped, assistant only."""
    t = F.coalesce("title", "content")
    both = F.when((F.coalesce("abs", F.lit("")) != "") & (F.col("abs") != t), F.concat(t, F.lit("，"), F.col("abs"))).otherwise(t)
    body = F.regexp_extract(both, r"\d+[.,\s、](.+)", 1)
    out = F.when(body != "", body).otherwise(both)
    return _keep(df.filter(F.coalesce(t, F.lit("")) != ""), F.array(say("assistant", out)))


@rowfunc
def query_response(df: DataFrame) -> DataFrame:
    """Query and response only."""
    return _keep(df, pair(F.col("query"), F.col("response")))


@rowfunc
def blossom_math(df: DataFrame) -> DataFrame:
    """The output, a blank line and the answer."""
    return _keep(df, pair(F.col("query"), F.concat("output", F.lit("\n\nAnswer: "), "answer")))


@rowfunc
def advert(df: DataFrame) -> DataFrame:
    """P7."""
    return _keep(df, pair(put(ADVERT, QUERY=F.col("content")), F.col("summary")))


@rowfunc
def firefly(df: DataFrame) -> DataFrame:
    """Known kinds only."""
    return _keep(df.filter(F.col("kind").isin(*FIREFLY_KINDS)), pair(F.col("input"), F.col("target")))


@rowfunc
def classify(df: DataFrame, labels: list[str], task: str, paired: bool) -> DataFrame:
    """An integer label as text after a template; a null label drops the row."""
    names = {"TASK": F.lit(task), "LABELS": F.lit(", ".join(labels)), "A": F.col("sentence1" if paired else "sentence")} | ({"B": F.col("sentence2")} if paired else {})
    return _keep(df.filter("label is not null"), pair(put(CLS_PAIR if paired else CLS_ONE, **names), F.element_at(F.array(*map(F.lit, labels)), F.col("label") + 1)))


@rowfunc
def labelled(df: DataFrame) -> DataFrame:
    """A question with its label as a number; a null label drops the row."""
    return _keep(df.filter("label is not null"), ask(F.col("query")), F.col("label").cast("int").alias("label"))


@rowfunc
def generation(df: DataFrame, template: str) -> DataFrame:
    """The query stands in the template's {{QUERY}}."""
    return _keep(df, pair(put(template, QUERY=F.col("query")), F.col("response")))


@rowfunc
def text_to_sql(df: DataFrame) -> DataFrame:
    """P10."""
    q = F.concat(F.lit("Sql Table information:\n"), "sql_context", F.lit("\n"), "sql_prompt")
    return _keep(df, pair(q, F.concat(F.lit("Let's think step by step:\n"), "sql_explanation", F.lit("\nSo the final sql is:\n"), "sql")))


@rowfunc
def two_turns(df: DataFrame) -> DataFrame:
    """Exactly two turns; `caller` and `conclusion` are assistants."""
    role = lambda r: F.when(r.isin("caller", "conclusion"), "assistant").otherwise(r)
    return _keep(df.filter(F.size("messages") == 2), F.transform("messages", lambda m: F.struct(role(m["role"]).alias("role"), m["content"].alias("content"))))


@rowfunc
def law(df: DataFrame) -> DataFrame:
    """Type, title, up to three chapters and the text, assistant only."""
    chapters = F.concat(*[F.coalesce(f"chapter{i}", F.lit("")) for i in (1, 2, 3)])
    return _keep(df, F.array(say("assistant", F.concat("type", F.lit("\n"), "title", F.lit("\n"), chapters, "response"))))


@rowfunc
def leetcode(df: DataFrame) -> DataFrame:
    """Split where the code begins."""
    at = F.instr("code_with_problem", "```python")
    head = F.when(at > 0, F.substr("code_with_problem", F.lit(1), at - 1)).otherwise(F.substr("code_with_problem", F.lit(1), F.length("code_with_problem") - 1))
    code = F.when(at > 0, F.trim(F.substr("code_with_problem", at))).otherwise(F.substr("code_with_problem", F.length("code_with_problem")))
    return _keep(df, pair(F.regexp_replace(head, "^# ", ""), F.concat(code, F.lit("\n\n"), "explanation_only")))


@rowfunc
def sentence_pairs(df: DataFrame, least: float | None = None) -> DataFrame:
    """Anchor, positive and score; only scores of at least `least`."""
    kept = df if least is None else df.filter(F.col("score").cast("double") >= least)
    return _keep(kept, ask(F.col("sentence1")), F.array(ask(F.col("sentence2"))).alias("positive_messages"), F.col("score").alias("label"))


@rowfunc
def similarity_text(df: DataFrame) -> DataFrame:
    """The score with one decimal as answer."""
    return _keep(df, pair(put(STS, A=F.col("sentence1"), B=F.col("sentence2")), F.format_string("%.1f", F.col("score"))))


@rowfunc
def similarity_label(df: DataFrame) -> DataFrame:
    """The score as label."""
    return _keep(df, ask(put(STS, A=F.col("sentence1"), B=F.col("sentence2"))), F.col("score").alias("label"))


@rowfunc
def rerank(df: DataFrame) -> DataFrame:
    """P20: positives and negatives as nested messages."""
    nest = lambda c: F.transform(c, lambda d: F.array(say("assistant", d)))
    return _keep(df, ask(F.col("query")), nest("positive").alias("positive_messages"), nest("negative").alias("negative_messages"))


@rowfunc
def countdown(df: DataFrame) -> DataFrame:
    """P23."""
    nums = F.concat(F.lit("["), F.array_join(F.transform("nums", lambda n: n.cast("string")), ", "), F.lit("]"))
    return _keep(df, ask(put(COUNTDOWN, A=nums, B=F.col("response").cast("string"))), F.col("response").alias("target"))


@rowfunc
def human_or_machine(df: DataFrame, as_label: bool = False) -> DataFrame:
    """Two rows of each question, one answer of each kind chosen by hash."""
    made = F.array(
        F.struct(F.lit(0).alias("label"), F.lit("Human").alias("name"), choose(F.col("human_answers"), "query").alias("answer")),
        F.struct(F.lit(1).alias("label"), F.lit("ChatGPT").alias("name"), choose(F.col("chatgpt_answers"), "query").alias("answer")),
    )
    each = df.select("query", F.explode(made).alias("m"))
    q = put(HC3, A=F.col("query"), B=F.col("m.answer"))
    return _keep(each, ask(q), F.col("m.label").alias("label")) if as_label else _keep(each, pair(q, F.col("m.name")))


@rowfunc
def dureader(df: DataFrame) -> DataFrame:
    """Answer and context parted by a mark."""
    p = F.split("text1", r"\[SEP\]")
    return _keep(df, pair(put(DUREADER, A=F.get(p, 1), B=F.get(p, 0)), F.col("text2")))


def _dialogue(text: Column) -> Column:
    """Alternate speaker parts of a marked transcript as user and assistant turns; a last part without partner is left out."""
    parts = F.transform(F.split(F.regexp_replace(F.trim(text), "^Human:", ""), "\n\nHuman:|\n\nAssistant:|\n\nHum:"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    whole = F.slice(parts, 1, F.floor(F.size(parts) / 2).cast("int") * 2)
    return F.transform(whole, lambda s, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), s.alias("content")))


@rowfunc
def preference_dialogue(df: DataFrame) -> DataFrame:
    """Chosen and rejected transcripts."""
    return _keep(df, _dialogue(F.col("chosen")), _dialogue(F.col("rejected")).alias("rejected_messages"))


@rowfunc
def function_calls(df: DataFrame) -> DataFrame:
    """JSON answers as tool-call turns."""
    calls = F.from_json("answers", "array<struct<name:string,arguments:map<string,string>>>")
    return _keep(df, F.concat(ask(F.col("query")), F.transform(calls, lambda c: say("tool_call", F.to_json(c)))), F.col("tools"))


@rowfunc
def function_call_choice(df: DataFrame) -> DataFrame:
    """One answer by hash, as an action."""
    calls = F.from_json("response", "array<struct<name:string,arguments:map<string,string>>>")
    one = choose(calls, "query")
    r = F.concat(F.lit("Action: "), one["name"], F.lit("\nAction Input: "), F.to_json(one["arguments"]))
    return _keep(df, pair(F.col("query"), r), r.alias("solution"), F.col("tools"))


@rowfunc
def chosen_appended(df: DataFrame) -> DataFrame:
    """The chosen turn after the context, the rejected text aside."""
    return _keep(df, F.concat("context", F.array("chosen")), F.col("rejected.content").alias("rejected_response"))


@rowfunc
def repaired_list(df: DataFrame) -> DataFrame:
    """Missing commas between objects inserted, then read as JSON."""
    fixed = F.regexp_replace(F.replace("conversation", F.lit("'"), F.lit('"')), r"\}\s*\{", "},{")
    return _keep(df, F.from_json(fixed, "array<struct<role:string,content:string>>")).filter("messages is not null")


@rowfunc
def without_variation_selector(df: DataFrame) -> DataFrame:
    """U+FE0F removed."""
    clean = lambda c: F.replace(F.col(c), F.lit("️"), F.lit(""))
    return _keep(df, pair(clean("query"), clean("response")), clean("rejected_response").alias("rejected_response"))


@rowfunc
def marked_history(df: DataFrame) -> DataFrame:
    """A history with speaker marks must alternate user and assistant and have no empty side."""
    marks = ["User:", "User：", "Assistant：", "Assistant:", "Asssistent:", "Assistent:", "Assistenz:"]
    p = split_by(F.coalesce(F.nullif("instruction", F.lit("")), F.lit("")), marks)
    own = df.withColumn("_p", p)
    user = lambda x: F.lower(x["key"]).contains("user")
    helper = lambda x: F.lower(x["key"]).rlike("ass?s?ist")
    fine = (F.size("_p") % 2 == 0) & F.forall(F.transform("_p", lambda x, i: F.when(i % 2 == 0, user(x)).otherwise(helper(x)) & (x["content"] != "")), lambda b: b)
    past = F.transform("_p", lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), x["content"].alias("content")))
    q = F.trim(F.regexp_replace("input", "^User:", ""))
    return _keep(own.filter(fine), F.concat(past, pair(q, F.col("output"))))


@rowfunc
def described_functions(df: DataFrame) -> DataFrame:
    """Tools from a description's paragraphs; a leading system turn dropped."""
    rest = F.when(F.get("messages", 0)["role"] == "system", F.slice("messages", 2, F.greatest(F.size("messages") - 1, F.lit(0)))).otherwise(F.col("messages"))
    return _keep(df, rest, F.when(F.col("function_description") != "", F.split("function_description", "\n\n")).alias("tools"))


@rowfunc
def with_context(df: DataFrame) -> DataFrame:
    """Useful information before the question."""
    head = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit(DOLLY), "context", F.lit("\n"))).otherwise("")
    return _keep(df, pair(F.concat(head, "instruction"), F.col("response")))


@rowfunc
def without_source(df: DataFrame, source: str = "toxic-dpo-v0.2") -> DataFrame:
    """One source left out."""
    return _keep(df.filter(F.col("source") != source), F.col("messages"))


@rowfunc
def self_cognition(df: DataFrame, name: tuple[str, str], author: tuple[str, str], query_suffix: str = "", response_prefix: str = "") -> DataFrame:
    """Placeholders by language tag, suffix and prefix."""
    fill = lambda c: F.replace(F.replace(F.col(c), F.lit("{{NAME}}"), F.when(F.col("tag") == "zh", name[0]).otherwise(name[1])), F.lit("{{AUTHOR}}"), F.when(F.col("tag") == "zh", author[0]).otherwise(author[1]))
    return _keep(df, pair(F.concat(fill("query"), F.lit(query_suffix)), F.concat(F.lit(response_prefix), fill("response"))))


@rowfunc
def sudoku(df: DataFrame) -> DataFrame:
    """Dots as zeros, lines of nine."""
    grid = lambda c: F.regexp_replace(F.regexp_replace(c, "(.{9})", "$1\n"), "\n$", "")
    return _keep(df, pair(F.concat(F.lit(SUDOKU), grid(F.replace("query", F.lit("."), F.lit("0")))), grid(F.col("response"))))


@rowfunc
def constant_query(df: DataFrame, query: str, label: bool = False) -> DataFrame:
    """One question for all images."""
    return _keep(df, ask(F.lit(query)), F.col("label")) if label else _keep(df, pair(F.lit(query), F.col("response")))


@rowfunc
def chosen_prompt(df: DataFrame, prompts: list[str]) -> DataFrame:
    """A question by hash; a leading description mark removed from the answer."""
    return _keep(df, pair(choose(prompts, "response"), F.regexp_replace("response", "^This image displays:\\s*", "")))


@rowfunc
def first_caption(df: DataFrame, query: str) -> DataFrame:
    """What stands before `&&`."""
    return _keep(df, pair(F.lit(query), F.get(F.split("caption", "&&"), 0)))


@rowfunc
def squeezed_transcript(df: DataFrame, query: str) -> DataFrame:
    """Spaces removed."""
    return _keep(df, pair(F.lit(query), F.replace("transcript", F.lit(" "), F.lit(""))))


@rowfunc
def digit_options(df: DataFrame, as_label: bool = False) -> DataFrame:
    """Options under the question; the digit as letter, or as label."""
    q = F.concat("query", F.lit("\n"), F.array_join("option", "\n"))
    return _keep(df, ask(q), F.col("response").cast("int").alias("label")) if as_label else _keep(df, pair(q, F.translate("response", "01234", "ABCDE")))


@rowfunc
def first_question(df: DataFrame) -> DataFrame:
    """The first question that is neither null nor the word None."""
    q = F.coalesce(*[F.nullif(c, F.lit("None")) for c in ("query", "question_1", "question_2")])
    return _keep(df.filter(q.isNotNull()), pair(q, F.col("response")))


@rowfunc
def existing_media(df: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file is among the known paths."""
    return df.join(known.select(F.col("path").alias(path)).distinct(), path, "left_semi")


@rowfunc
def rewritten_paths(df: DataFrame, table: dict[str, str], path: str = "path") -> DataFrame:
    """The first matching part of a path replaced; others stay."""
    p = F.col(path)
    return df.withColumn(path, F.coalesce(*[F.when(F.contains(p, F.lit(k)), F.replace(p, F.lit(k), F.lit(v))) for k, v in table.items()], p))


@rowfunc
def referred_box(df: DataFrame, prompts: list[str]) -> DataFrame:
    """The first caption and the rounded box; the question by hash."""
    box = F.transform("bbox", lambda v: F.bround(v.cast("double"), 0).cast("int"))
    objects = F.struct(F.slice("captions", 1, 1).alias("ref"), F.array(box).alias("bbox"))
    return _keep(df, pair(choose(prompts, "image"), F.lit(REF)), as_media(F.col("image"), False).alias("images"), objects.alias("objects"))


@rowfunc
def one_of_questions(df: DataFrame) -> DataFrame:
    """A question and its answer, by hash."""
    both = choose(F.arrays_zip("questions", "answers"), "image")
    return _keep(df, pair(both["questions"], both["answers"]))


@rowfunc
def choice_with_rationale(df: DataFrame) -> DataFrame:
    """The chosen option after the solution."""
    q = F.concat("question", F.lit("\n"), F.array_join(F.transform("choices", lambda c, i: F.concat(F.chr(i + 65), F.lit(". "), c)), "\n"))
    return _keep(df, pair(q, F.concat("solution", F.lit("\nAnswer: "), F.element_at("choices", F.col("answer") + 1))))


@rowfunc
def tagged_spans(df: DataFrame) -> DataFrame:
    """Spans sorted; rows with overlapping or no spans dropped; spans replaced by tags."""
    s = F.array_sort(F.transform("ref_exps", lambda r: F.struct(F.get(r, 0).cast("int").alias("a"), F.get(r, 1).cast("int").alias("b"), F.slice(r, 3, 4).alias("box"))))
    own = df.withColumn("_s", s).filter(F.size("ref_exps") > 0)
    clash = F.exists(F.zip_with(F.slice("_s", 1, F.size("_s") - 1), F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), lambda x, y: y["a"] < x["b"]), lambda b: b)
    fold = F.aggregate(
        "_s", F.struct(F.lit(0).alias("at"), F.lit("").alias("t")), lambda a, x: F.struct(x["b"].alias("at"), F.concat(a["t"], F.substr(F.col("caption"), a["at"] + 1, x["a"] - a["at"]), F.lit(REF)).alias("t")),
        lambda a: F.concat(a["t"], F.substr(F.col("caption"), a["at"] + 1)),
    )
    objects = F.struct(F.transform("_s", lambda x: F.substr(F.col("caption"), x["a"] + 1, x["b"] - x["a"])).alias("ref"), F.transform("_s", lambda x: x["box"]).alias("bbox"))
    return _keep(own.filter(~clash), pair(F.lit("what is the proper caption of this image?"), fold), objects.alias("objects"))


@rowfunc
def detection(df: DataFrame, names: list[str]) -> DataFrame:
    """Category numbers as names, a tag for each."""
    refs = F.transform("categories", lambda c: F.element_at(F.array(*map(F.lit, names)), c + 1))
    return _keep(df, pair(F.lit("Task: Object Detection"), F.array_join(F.transform("categories", lambda c: F.lit(REF)), "\n")), refs.alias("refs"))


@rowfunc
def typed_content(df: DataFrame) -> DataFrame:
    """Lists of text and image parts as text with tags."""
    part = lambda c: F.when(c["type"] == "text", F.coalesce(c["text"], F.lit(""))).when(c["type"] == "image", "<image>").otherwise("")
    return _keep(df, F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.array_join(F.transform(m["content"], part), "").alias("content"))))


@rowfunc
def with_instruction(df: DataFrame, instruction: str) -> DataFrame:
    """An instruction after the question."""
    return _keep(df, pair(F.concat("query", F.lit(instruction)), F.col("response")))


@rowfunc
def one_hot(df: DataFrame) -> DataFrame:
    """The places of ones."""
    return _keep(df, ask(F.lit("")), F.filter(F.transform("onehot", lambda v, i: F.when(v == 1, i)), lambda v: v.isNotNull()).alias("label"))


@rowfunc
def response_as_solution(df: DataFrame) -> DataFrame:
    """P72."""
    return _keep(df, pair(F.col("query"), F.col("response")), F.col("response").alias("solution"))


@rowfunc
def role_play(df: DataFrame) -> DataFrame:
    """A system turn made of the turns between the first and the last; rows without question or answer dropped."""
    first = F.get("conversations", 0)
    n = F.size("conversations")
    middle = F.array_join(F.transform(F.slice("conversations", 2, F.greatest(n - 2, F.lit(0))), lambda c: F.concat(F.lit("\n "), c["from"], F.lit(":"), c["value"])), "")
    system = F.when(first["from"] == "system", first["value"]).otherwise("")
    query = F.when(first["from"] == "user", first["value"]).otherwise("")
    full = F.when((query == "") & ~F.contains(system, F.lit("next_speakers:")), F.concat(system, F.lit("\n\n【chat history】"), middle)).otherwise(system)
    answer = F.get("conversations", n - 1)["value"]
    return _keep(df.filter((query != "") & (F.coalesce(answer, F.lit("")) != "")), F.array(say("system", full), say("user", query), say("assistant", answer)))


@rowfunc
def speech(df: DataFrame) -> DataFrame:
    """Text to speak with its reference recording."""
    return _keep(df, F.array(say("user", F.col("text")), say("assistant", F.lit("<audio>"))), as_media(F.col("audio"), False).alias("audios"), as_media(F.col("ref_audio"), False).alias("ref_audios"))


#: Words that mark other assistants' transcripts.
OTHER_MARKS = ("moss", "human:", "assistant:", "user:")


@rowfunc
def without_marks(df: DataFrame, system: str = "You are a helpful assistant.") -> DataFrame:
    """P5: the default system turn dropped; rows that carry another assistant's marks left out."""
    first = F.get("messages", 0)
    plain = F.when((first["role"] == "system") & (first["content"] == system), F.slice("messages", 2, F.greatest(F.size("messages") - 1, F.lit(0)))).otherwise(F.col("messages"))
    held = lambda m: F.exists(F.array(*map(F.lit, OTHER_MARKS)), lambda w: F.contains(F.lower(m["content"]), w))
    return _keep(df.withColumn("messages", plain).filter(~F.exists("messages", held)), F.col("messages"))


@rowfunc
def many_plugins(df: DataFrame) -> DataFrame:
    """Rows whose leading system turn names more than one plugin."""
    first = F.get("messages", 0)
    names = F.array_distinct(F.regexp_extract_all(first["content"], F.lit(r'\d\. \{"plugin_name": "(.+?)"'), F.lit(1)))
    return _keep(df.filter((first["role"] == "system") & (F.size(names) > 1)), F.col("messages"))


@rowfunc
def sql_create_context(df: DataFrame) -> DataFrame:
    """Question, tables and answer as instruction, input and output."""
    return _keep(df, pair(alpaca_query(F.col("question"), F.col("context")), F.col("answer")))


@rowfunc
def chat_rounds(df: DataFrame) -> DataFrame:
    """The column `chat_rounds` is the conversation."""
    return _keep(df, F.col("chat_rounds"))


@rowfunc
def dense_caption(df: DataFrame, prompts: list[str]) -> DataFrame:
    """The global caption of a literal, a question by hash."""
    caption = F.get_json_object(lenient(F.col("cap_seg")).cast("string"), "$.global_caption")
    return _keep(df, pair(choose(prompts, "url"), caption), as_media(F.col("url"), False).alias("images"))


@rowfunc
def first_of_nested(df: DataFrame) -> DataFrame:
    """The first question of a video and its answer."""
    one = F.get("global", 0)
    return _keep(df, pair(one["question"], one["answer"]), as_media(F.col("info.video_path"), False).alias("videos"))


#: What can be done on a page.
PAGE_TOOLS = (
    ("CLICK", "Choose and click an element in the web page", {"element": "string, the element in the web page to click"}),
    ("TYPE", "Input some text into a web element like <input> or <textbox>", {"element": "string, the element in the web page to input to", "content": "string, what content to input into the textbox element"}),
    ("SELECT", "Select an element from a combobox", {"element": "string, the combobox or dropdown in the web page on which the select happens", "content": "string, which choices to choose"}),
)


@rowfunc
def page_actions(df: DataFrame, order: str, session: str) -> DataFrame:
    """One conversation a session, its rows in order: the page as question, the last action as answer; the task stands with index 0.

    `session` names the conversation, as attempts.sessions numbers it from the rows of index 0.
    """
    steps = F.split("target_action_reprs", "->")
    last = F.element_at(steps, -1)
    colon = F.instr(last, ":")
    what = F.when(colon > 0, F.concat(F.lit(","), F.trim(F.substr(last, colon + 1)))).otherwise("")
    action = F.trim(F.when(colon > 0, F.substr(last, F.lit(1), colon - 1)).otherwise(last))
    where = F.when(F.size(steps) > 1, F.trim(F.get(steps, 0))).otherwise("")
    query = F.concat(F.lit("The snapshot of screen:<image>\nThe html source code:"), "cleaned_html", F.lit("\n"), F.when(F.col("target_action_index") == "0", F.concat(F.lit("\n"), "confirmed_task")).otherwise(""))
    response = F.concat(F.lit("Action: "), action, F.lit("\nAction Input: "), where, what)
    turns = df.select(session, F.struct(F.col(order).alias("o"), pair(query, response).alias("m"), F.col("screenshot").alias("image")).alias("t"))
    listed = turns.groupBy(session).agg(F.array_sort(F.collect_list("t")).alias("t"))  # a session is one conversation
    tools = F.array(*[F.to_json(F.struct(F.lit(n).alias("name"), F.lit(d).alias("desc"), F.struct(*[F.lit(v).alias(k) for k, v in p.items()]).alias("parameter"))) for n, d, p in PAGE_TOOLS])
    return listed.select(session, F.flatten(F.transform("t", lambda x: x["m"])).alias("messages"), F.transform("t", lambda x: x["image"]).alias("images"), tools.alias("tools"))


@rowfunc
def caption_pairs(df: DataFrame) -> DataFrame:
    """An image as anchor, its first caption as positive."""
    return _keep(df, ask(F.lit("<image>")), F.array(ask(F.get("response", 0))).alias("positive_messages"))


@rowfunc
def caption_rerank(df: DataFrame, key: str, k: int = 7) -> DataFrame:
    """The first caption as positive, k captions of other images from the whole pool as negatives."""
    from .sampling import negatives

    pool = df.select(F.explode("response").alias("item"))
    met = negatives(df.select(key, "response"), pool, key, "response", "item", k)
    other = met.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: ask(x["item"])).alias("negative_messages"))  # k a row
    nothing = F.array().cast("array<array<struct<role:string,content:string>>>")
    # a list a row is no small side, though Spark judges it by its file
    return df.join(other.hint("merge"), key, "left").select(key, ask(F.lit("<image>")).alias("messages"), F.array(ask(F.get("response", 0))).alias("positive_messages"), F.coalesce("negative_messages", nothing).alias("negative_messages"))
