"""Queries of the row functions of known dataset shapes: parts, documents and conversations take the shapes' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rowfuncs as P
from .common import table

C, L = F.col, F.lit


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(C("p_partkey").alias("k"), C("p_name").alias("n"), C("p_brand").alias("b"), C("p_type").alias("t"), C("p_size").alias("s"))


def _told(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], L(":"), m["content"])), "\n")


def _nested(c: Column) -> Column:
    return F.array_join(F.transform(c, _told), "|")


def _flat(df: DataFrame, **extra: Column) -> DataFrame:
    return df.select(_told(C("messages")).alias("flat"), *[c.alias(n) for n, c in extra.items()])


def _turns(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(L(r).alias("role"), c.alias("content")) for r, c in pairs])


# SQL of one turn, and of turns in order; n, b, t, s and k are a part's columns
_P = "p as (select p_partkey k, p_name n, p_brand b, p_type t, p_size s from part)"


def _say(*turns: str) -> str:
    """role=expression, in order."""
    return " || chr(10) || ".join(f"'{x.split('=', 1)[0]}:' || {x.split('=', 1)[1]}" for x in turns)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _chosen(options: str, n: str, key: str) -> str:
    return f"({options})[('0x' || substr(md5({key}), 1, 8))::bigint % {n} + 1]"


QUERIES: dict = {}


def shape(name: str, note: str, f, sql: str) -> None:
    """Register a query over parts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(_parts(spark, sf_dir))

    run.__name__, run.__doc__ = f"shape_{name}", note
    QUERIES[f"shape_{name}"] = (run, f"with {_P} {sql}")



def odd() -> Column:
    return C("k") % 2 == 1


def third() -> Column:
    return C("k") % 3


def nothing() -> Column:
    return L(None).cast("string")


shape("titles", "P3", lambda p: _flat(P.titles(p.select(F.when(third() != 0, F.concat(L("12. "), "n")).alias("title"), F.when(odd(), C("b")).otherwise(F.concat(L("12. "), "n")).alias("abs"), F.when(C("k") % 5 != 0, C("t")).alias("content")))),
      """, q as (select case when k % 3 <> 0 then '12. ' || n when k % 5 <> 0 then t end t0, case when k % 2 = 1 then b else '12. ' || n end a from p), r as (select case when a <> t0 then t0 || '，' || a else t0 end x from q where coalesce(t0, '') <> '')
      select 'assistant:' || coalesce(nullif(regexp_extract(x, '\\d+[.,\\s、](.+)', 1), ''), x) flat from r""")
shape("query_response", "P4", lambda p: _flat(P.query_response(p.select(C("n").alias("query"), C("t").alias("response"), "b"))), f"select {_say('user=n', 'assistant=t')} flat from p")
shape("without_marks", "P5, B12", lambda p: _flat(P.without_marks(p.select(_turns(("system", F.when(odd(), L("You are a helpful assistant.")).otherwise(C("b"))), ("user", C("n")), ("assistant", F.when(third() == 0, F.concat(L("I am MOSS "), "t")).otherwise(C("t")))).alias("messages")))),
      f"select case when k % 2 = 1 then '' else 'system:' || b || chr(10) end || {_say('user=n', 'assistant=t')} flat from p where k % 3 <> 0")
shape("many_plugins", "P6, B13", lambda p: _flat(P.many_plugins(p.select(_turns(("system", F.concat(L('1. {"plugin_name": "a"} 2. {"plugin_name": "'), F.when(odd(), L("a")).otherwise(C("b")), L('"}'))), ("user", C("n"))).alias("messages")))),
      f"""select {_say("system='1. {\"plugin_name\": \"a\"} 2. {\"plugin_name\": \"' || b || '\"}'", 'user=n')} flat from p where k % 2 = 0""")
shape("advert", "P7", lambda p: _flat(P.advert(p.select(C("n").alias("content"), C("t").alias("summary")))), f"select {_say('user=' + _q(P.ADVERT.split('{{')[0]) + ' || n || ' + _q(P.ADVERT.split('}}')[1]), 'assistant=t')} flat from p")
shape("firefly", "P8, B14", lambda p: _flat(P.firefly(p.select(F.when(third() == 0, L("Cot")).when(third() == 1, L("NLI")).otherwise(C("t")).alias("kind"), C("n").alias("input"), C("t").alias("target")))), f"select {_say('user=n', 'assistant=t')} flat from p where k % 3 <> 2")
shape("two_turns", "P11", lambda p: _flat(P.two_turns(p.select(F.when(odd(), _turns(("user", C("n")), ("caller", C("t")))).when(third() == 0, _turns(("user", C("n")), ("conclusion", C("b")))).otherwise(_turns(("user", C("n")))).alias("messages")))),
      f"select {_say('user=n', 'assistant=case when k % 2 = 1 then t else b end')} flat from p where k % 2 = 1 or k % 3 = 0")
shape("blossom_math", "P12", lambda p: _flat(P.blossom_math(p.select(C("n").alias("query"), C("t").alias("output"), C("b").alias("answer")))), f"""select {_say('user=n', "assistant=t || chr(10) || chr(10) || 'Answer: ' || b")} flat from p""")
shape("sql_create_context", "P13", lambda p: _flat(P.sql_create_context(p.select(C("n").alias("question"), F.when(odd(), C("b")).otherwise("").alias("context"), C("t").alias("answer")))), f"select {_say('user=n || case when k % 2 = 1 then chr(10) || b else ' + _q('') + ' end', 'assistant=t')} flat from p")
shape("chat_rounds", "P15", lambda p: _flat(P.chat_rounds(p.select(_turns(("user", C("n")), ("assistant", C("t"))).alias("chat_rounds")))), f"select {_say('user=n', 'assistant=t')} flat from p")
shape("leetcode", "P16", lambda p: _flat(P.leetcode(p.select(F.concat(F.when(odd(), L("# ")).otherwise(""), "n", F.when(third() != 0, F.concat(L(" ```python "), "b")).otherwise("!")).alias("code_with_problem"), C("t").alias("explanation_only")))),
      f"""select {_say("user=n || case when k % 3 <> 0 then ' ' else '' end", "assistant=case when k % 3 <> 0 then '```python ' || b else '!' end || chr(10) || chr(10) || t")} flat from p""")
shape("similarity_label", "P19", lambda p: _flat(P.similarity_label(p.select(C("n").alias("sentence1"), C("t").alias("sentence2"), (C("s") / 50.0).alias("score"))), label=C("label")),
      f"""select {_say("user='Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.' || chr(10) || 'Sentence 1: ' || n || chr(10) || 'Sentence 2: ' || t || chr(10) || 'Similarity score: '")} flat, s / 50.0::double as label from p""")
shape("rerank", "P20", lambda p: _flat(P.rerank(p.select(C("n").alias("query"), F.array("t").alias("positive"), F.slice(F.array("b", "n"), 1, F.when(odd(), 2).otherwise(1)).alias("negative"))), yes=_nested(C("positive_messages")), no=_nested(C("negative_messages"))),
      "select 'user:' || n flat, 'assistant:' || t yes, 'assistant:' || b || case when k % 2 = 1 then '|assistant:' || n else '' end as no from p")
shape("repaired_list", "P21, P31", lambda p: _flat(P.repaired_list(p.select(F.concat(L("[{'role': 'user', 'content': '"), "n", L("'}"), F.when(odd(), L(", ")).otherwise("\n "), L("{'role': 'assistant', 'content': '"), "t", F.when(third() == 0, L("'}")).otherwise("'}]")).alias("conversation")))),
      f"select {_say('user=n', 'assistant=t')} flat from p where k % 3 <> 0")
shape("role_play", "P22", lambda p: _flat(P.role_play(p.select(F.array(*[F.struct(r.alias("from"), v.alias("value")) for r, v in ((F.when(odd(), L("user")).otherwise(L("system")), C("n")), (C("b"), C("t")), (L("ann"), F.when(third() == 0, "").otherwise(C("t"))))]).alias("conversations")))),
      f"select {_say(chr(39).join(['system=', '', '']) , 'user=n', 'assistant=t')} flat from p where k % 2 = 1 and k % 3 <> 0")
shape("countdown", "P23", lambda p: _flat(P.countdown(p.select(F.array("s", F.lit(3)).alias("nums"), C("s").alias("response"))), target=C("target")),
      f"select {_say('user=' + _q(P.COUNTDOWN).replace('{{A}}', chr(39) + ' || ' + chr(39) + '[' + chr(39) + ' || s || ' + chr(39) + ', 3]').replace('{{B}}', chr(39) + ' || s || ' + chr(39)))} flat, s target from p")
_HC = "'Classification Task: Are the following responses from a human or from ChatGPT?' || chr(10) || 'Question: ' || n || chr(10) || 'Answer: ' || a || chr(10) || 'Category: Human, ChatGPT' || chr(10) || 'Output:'"
_HCQ = f", q as (select n, 0 l, 'Human' m, {_chosen('[b, t]', '2', 'n')} a from p union all select n, 1, 'ChatGPT', {_chosen('[t, b, n]', '3', 'n')} from p)"
_hc = lambda p: p.select(C("n").alias("query"), F.array("b", "t").alias("human_answers"), F.array("t", "b", "n").alias("chatgpt_answers"))
shape("human_or_machine", "P24", lambda p: _flat(P.human_or_machine(_hc(p))), f"{_HCQ} select {_say('user=' + _HC, 'assistant=m')} flat from q")
shape("human_or_machine_label", "P25", lambda p: _flat(P.human_or_machine(_hc(p), True), label=C("label")), f"{_HCQ} select {_say('user=' + _HC)} flat, l as label from q")
shape("dureader", "P26", lambda p: _flat(P.dureader(p.select(F.concat("n", L("[SEP]"), "b").alias("text1"), C("t").alias("text2")))), f"""select {_say("user='Task: Question Generation' || chr(10) || 'Context: ' || b || chr(10) || 'Answer: ' || n || chr(10) || 'Question:'", 'assistant=t')} flat from p""")


def _calls() -> Column:
    return F.concat(L('[{"name": "f'), (C("k") % 4).cast("string"), L('", "arguments": {"x": "'), "b", L('"}}'), F.when(odd(), L(', {"name": "g", "arguments": {}}')).otherwise(""), L("]"))


_F1 = """'{"name":"f' || k % 4 || '","arguments":{"x":"' || b || '"}}'"""
shape("function_calls", "P28", lambda p: _flat(P.function_calls(p.select(C("n").alias("query"), _calls().alias("answers"), C("t").alias("tools"))), tools=C("tools")),
      f"""select {_say('user=n', 'tool_call=' + _F1)} || case when k % 2 = 1 then chr(10) || 'tool_call:{{"name":"g","arguments":{{}}}}' else '' end flat, t tools from p""")
shape("function_call_choice", "P29", lambda p: _flat(P.function_call_choice(p.select(C("n").alias("query"), _calls().alias("response"), C("t").alias("tools"))), solution=C("solution")),
      f""", q as (select n, {_chosen("['f' || k % 4, 'g']", "case when k % 2 = 1 then 2 else 1 end", "n")} f, b from p), r as (select n, 'Action: ' || f || chr(10) || 'Action Input: ' || case when f = 'g' then '{{}}' else '{{"x":"' || b || '"}}' end a from q) select {_say('user=n', 'assistant=a')} flat, a solution from r""")
shape("chosen_appended", "P30", lambda p: _flat(P.chosen_appended(p.select(_turns(("user", C("n"))).alias("context"), F.struct(L("assistant").alias("role"), C("t").alias("content")).alias("chosen"), F.struct(L("assistant").alias("role"), C("b").alias("content")).alias("rejected"))), rejected=C("rejected_response")), f"select {_say('user=n', 'assistant=t')} flat, b rejected from p")
shape("without_variation_selector", "P32", lambda p: _flat(P.without_variation_selector(p.select(F.concat("n", L("☀️")).alias("query"), F.concat(L("️"), "t").alias("response"), C("b").alias("rejected_response"))), rejected=C("rejected_response")), f"select {_say('user=n || chr(9728)', 'assistant=t')} flat, b rejected from p")
shape("marked_history", "P33", lambda p: _flat(P.marked_history(p.select(F.when(odd(), F.concat(L("User:"), "b", L("Assistant:"), F.when(third() == 0, "").otherwise(C("t")))).otherwise("").alias("instruction"), F.concat(L("User:"), "n").alias("input"), C("t").alias("output")))),
      f"select case when k % 2 = 1 then {_say('user=b', 'assistant=t')} || chr(10) else '' end || {_say('user=n', 'assistant=t')} flat from p where k % 2 = 0 or k % 3 <> 0")
shape("described_functions", "P34", lambda p: _flat(P.described_functions(p.select(F.when(odd(), _turns(("system", C("b")), ("user", C("n")))).otherwise(_turns(("user", C("n")))).alias("messages"), F.when(third() == 0, "").otherwise(F.concat("b", L("\n\n"), "t")).alias("function_description"))), tools=F.coalesce(F.array_join("tools", "|"), L("none"))),
      "select 'user:' || n flat, case when k % 3 = 0 then 'none' else b || '|' || t end tools from p")
shape("without_source", "P36", lambda p: _flat(P.without_source(p.select(_turns(("user", C("n"))).alias("messages"), F.when(odd(), L("toxic-dpo-v0.2")).otherwise(C("b")).alias("source")))), "select 'user:' || n flat from p where k % 2 = 0")
shape("self_cognition", "P37, H21", lambda p: _flat(P.self_cognition(p.select(F.concat("n", L(" {{NAME}}")).alias("query"), F.concat(L("{{AUTHOR}} made {{NAME}} "), "t").alias("response"), F.when(odd(), L("zh")).otherwise("en").alias("tag")), ("小羽", "Quill"), ("众人", "All"), "?", "> ")),
      f""", q as (select *, case when k % 2 = 1 then '小羽' else 'Quill' end nm, case when k % 2 = 1 then '众人' else 'All' end au from p) select {_say("user=n || ' ' || nm || '?'", "assistant='> ' || au || ' made ' || nm || ' ' || t")} flat from q""")
shape("constant_query", "P40, P41, P56, P68, P69", lambda p: _flat(P.constant_query(p.select(C("t").alias("response")), "What is it?")).unionByName(_flat(P.constant_query(p.select(C("s").alias("label")), "Which?", True).select("messages"))),
      f"""select {_say("user='What is it?'", 'assistant=t')} flat from p union all select 'user:Which?' from p""")
shape("chosen_prompt", "P42, P47", lambda p: _flat(P.chosen_prompt(p.select(F.when(odd(), F.concat(L("This image displays:  "), "n")).otherwise(C("n")).alias("response")), ["What?", "Tell me.", "Describe."])),
      f""", q as (select case when k % 2 = 1 then 'This image displays:  ' || n else n end r, n from p) select {_say('user=' + _chosen("['What?', 'Tell me.', 'Describe.']", '3', 'r'), 'assistant=n')} flat from q""")
shape("dense_caption", "P43", lambda p: _flat(P.dense_caption(p.select(C("b").alias("url"), F.concat(L("{'global_caption': '"), "n", L("', 'local': [1, None]}")).alias("cap_seg")), ["What?", "Tell me."]), n_images=F.size("images")),
      f"""select {_say('user=' + _chosen("['What?', 'Tell me.']", '2', 'b'), 'assistant=n')} flat, 1 n_images from p""")
shape("first_caption", "P44", lambda p: _flat(P.first_caption(p.select(F.concat("n", F.when(odd(), F.concat(L("&&"), "t")).otherwise("")).alias("caption")), "Describe.")), f"""select {_say("user='Describe.'", 'assistant=n')} flat from p""")
shape("squeezed_transcript", "P48", lambda p: _flat(P.squeezed_transcript(p.select(F.concat("n", L(" "), "t").alias("transcript")), "Say it.")), f"""select {_say("user='Say it.'", "assistant=replace(n, ' ', '') || replace(t, ' ', '')")} flat from p""")
_opt = lambda p: p.select(C("n").alias("query"), F.array("b", "t").alias("option"), (C("k") % 5).cast("string").alias("response"))
shape("digit_options", "P49", lambda p: _flat(P.digit_options(_opt(p))), f"""select {_say('user=n || chr(10) || b || chr(10) || t', "assistant=chr((65 + k % 5)::int)")} flat from p""")
shape("digit_options_label", "P50", lambda p: _flat(P.digit_options(_opt(p), True), label=C("label")), "select 'user:' || n || chr(10) || b || chr(10) || t flat, (k % 5)::int as label from p")
shape("first_of_nested", "P52", lambda p: _flat(P.first_of_nested(p.select(F.struct(C("b").alias("video_path")).alias("info"), F.array(F.struct(C("n").alias("question"), C("t").alias("answer")), F.struct(C("b").alias("question"), C("b").alias("answer"))).alias("global"))), video=F.get("videos", L(0))["path"]), f"select {_say('user=n', 'assistant=t')} flat, b video from p")
shape("first_question", "P53", lambda p: _flat(P.first_question(p.select(F.when(odd(), L("None")).otherwise(C("n")).alias("query"), F.when(third() == 0, nothing()).otherwise(C("b")).alias("question_1"), F.when(C("k") % 5 == 0, L("None")).otherwise(C("t")).alias("question_2"), C("t").alias("response")))),
      f", q as (select case when k % 2 = 0 then n when k % 3 <> 0 then b when k % 5 <> 0 then t end q, t from p) select {_say('user=q', 'assistant=t')} flat from q where q is not null")
shape("existing_media", "P39, P45, P46, P51, P55, P60", lambda p: P.existing_media(p.select(C("b").alias("path"), "n"), p.filter("k % 7 = 0").select(C("b").alias("path"))).select("path", "n"), "select b as path, n from p where b in (select b from p where k % 7 = 0)")
shape("rewritten_paths", "P46, P55, P60", lambda p: P.rewritten_paths(p.select(F.concat(L("data/"), "b", L("/x")).alias("path")), {"Brand#1": "one", "#2": "two"}), "select 'data/' || case when contains(b, 'Brand#1') then replace(b, 'Brand#1', 'one') else replace(b, '#2', 'two') end || '/x' as path from p")
shape("referred_box", "P59, N6", lambda p: P.referred_box(p.select(C("b").alias("image"), F.array("n", "t").alias("captions"), F.array(C("s") + 0.5, C("s") + 1.5, L(2.4), L(7.6)).alias("bbox")), ["Where?", "Find it."]).select(_told(C("messages")).alias("flat"), F.array_join("objects.ref", ",").alias("ref"), F.array_join(F.transform(F.get("objects.bbox", L(0)), lambda v: v.cast("string")), ",").alias("box")),
      f"""select {_say('user=' + _chosen("['Where?', 'Find it.']", '2', 'b'), "assistant='<ref-object><bbox>'")} flat, n as ref, (s + s % 2)::varchar || ',' || (s + 1 + (s + 1) % 2)::varchar || ',2,8' box from p""")
shape("one_of_questions", "P62", lambda p: _flat(P.one_of_questions(p.select(C("n").alias("image"), F.array("b", "t").alias("questions"), F.array("t", "n").alias("answers")))), f"select {_say('user=' + _chosen('[b, t]', '2', 'n'), 'assistant=' + _chosen('[t, n]', '2', 'n'))} flat from p")
shape("choice_with_rationale", "P63", lambda p: _flat(P.choice_with_rationale(p.select(C("n").alias("question"), F.array("b", "t").alias("choices"), (C("k") % 2).cast("int").alias("answer"), F.concat("t", L(".")).alias("solution")))),
      f"""select {_say("user=n || chr(10) || 'A. ' || b || chr(10) || 'B. ' || t", "assistant=t || '.' || chr(10) || 'Answer: ' || case when k % 2 = 0 then b else t end")} flat from p""")
shape("detection", "P66", lambda p: _flat(P.detection(p.select(F.slice(F.array((C("k") % 3).cast("int"), (C("s") % 3).cast("int")), 1, F.when(odd(), 1).otherwise(2)).alias("categories")), ["cat", "dog", "cow"]), refs=F.array_join("refs", ",")),
      f"""select {_say("user='Task: Object Detection'", "assistant='<ref-object><bbox>' || case when k % 2 = 0 then chr(10) || '<ref-object><bbox>' else '' end")} flat, (['cat', 'dog', 'cow'])[k % 3 + 1] || case when k % 2 = 0 then ',' || (['cat', 'dog', 'cow'])[s % 3 + 1] else '' end refs from p""")
shape("typed_content", "P67, N9", lambda p: _flat(P.typed_content(p.select(F.array(F.struct(L("user").alias("role"), F.array(F.struct(L("image").alias("type"), nothing().alias("text")), F.struct(L("text").alias("type"), C("n").alias("text")), F.struct(L("sound").alias("type"), C("b").alias("text"))).alias("content"))).alias("messages")))), "select 'user:<image>' || n flat from p")
shape("with_instruction", "P70", lambda p: _flat(P.with_instruction(p.select(C("n").alias("query"), C("t").alias("response")), " Think.")), f"""select {_say("user=n || ' Think.'", 'assistant=t')} flat from p""")
shape("one_hot", "P71", lambda p: P.one_hot(p.select(F.array((C("k") % 2).cast("int"), (C("s") % 2).cast("int"), L(1)).alias("onehot"))).select(F.array_join(F.transform("label", lambda v: v.cast("string")), ",").alias("labels")), "select case when k % 2 = 1 then '0,' else '' end || case when s % 2 = 1 then '1,' else '' end || '2' labels from p")
shape("response_as_solution", "P72", lambda p: _flat(P.response_as_solution(p.select(C("n").alias("query"), C("t").alias("response"))), solution=C("solution")), f"select {_say('user=n', 'assistant=t')} flat, t solution from p")
shape("speech", "P73", lambda p: _flat(P.speech(p.select(C("n").alias("text"), C("b").alias("audio"), C("t").alias("ref_audio"))), sound=F.get("audios", L(0))["path"], like=F.get("ref_audios", L(0))["path"]), f"""select {_say('user=n', "assistant='<audio>'")} flat, b sound, t "like" from p""")
shape("caption_pairs", "P57", lambda p: P.caption_pairs(p.select(F.array("n", "t").alias("response"))).select(_told(C("messages")).alias("flat"), _nested(C("positive_messages")).alias("yes")), "select 'user:<image>' flat, 'user:' || n yes from p")


def shape_caption_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three captions of other images (stand-in: part types and brands) for each."""
    out = P.caption_rerank(_parts(spark, sf_dir).select("k", F.array("n", "b").alias("response")), "k", 3)
    return out.select("k", _nested(C("positive_messages")).alias("yes"), _nested(C("negative_messages")).alias("no"))


def shape_page_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as actions on pages, eight a task."""
    p = _parts(spark, sf_dir)
    action = F.when(third() == 0, F.concat(L("[link] "), "n", L(" -> CLICK"))).when(third() == 1, F.concat(L("[box] "), "b", L(" -> TYPE: "), "t")).otherwise(L("CLICK"))
    d = p.select("k", F.floor(C("k") / 8).alias("task"), (C("k") % 8).cast("string").alias("target_action_index"), C("n").alias("cleaned_html"), C("b").alias("screenshot"), C("t").alias("confirmed_task"), action.alias("target_action_reprs"))
    out = P.page_actions(d, "k", "task")
    return out.select("task", _told(C("messages")).alias("flat"), F.array_join("images", ",").alias("images"), F.array_join(F.transform("tools", lambda t: F.get_json_object(t, "$.name")), ",").alias("tools"))


QUERIES["shape_caption_rerank"] = (shape_caption_rerank, f"""with {_P}, c as (select k, unnest([n, b]) item from p), o as (select item, row_number() over (order by sha256('42|pool|' || item), item) pl from (select distinct item from c)), m as (select count(*) z from o),
    j as (select k, n, b, z, unnest(range(1, least(z, 5) + 1)) j, ('0x' || substr(sha256('42|negative|' || k::varchar), 1, 12))::bigint % z f from p, m), r as (select k, item, row_number() over (partition by k order by j) place from j join o on o.pl = (f + j - 1) % z + 1 where item not in (n, b))
    select k, 'user:' || n yes, (select string_agg('user:' || item, '|' order by place) from r where r.k = p.k and place <= 3) as no from p""")
QUERIES["shape_page_actions"] = (shape_page_actions, f"""with {_P} select k // 8 task, string_agg('user:The snapshot of screen:<image>' || chr(10) || 'The html source code:' || n || chr(10) || case when k % 8 = 0 then chr(10) || t else '' end || chr(10) || 'assistant:Action: '
    || case k % 3 when 0 then 'CLICK' when 1 then 'TYPE' else 'CLICK' end || chr(10) || 'Action Input: ' || case k % 3 when 0 then '[link] ' || n when 1 then '[box] ' || b || ',' || t else '' end, chr(10) order by k) flat, string_agg(b, ',' order by k) images, 'CLICK,TYPE,SELECT' tools from p group by 1""")
