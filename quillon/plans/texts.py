"""Queries of the text functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _md5(c):
    return F.md5(c.cast("binary"))


def doc_text_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H2, H3, H5: normal forms of each text, as digests."""
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", _md5(T.norm_ascii(t)).alias("h1"), _md5(T.norm_underscore(t)).alias("h2"), _md5(T.norm_space(t, "unknown")).alias("h3"), _md5(T.norm_concept(t)).alias("h5"))


def doc_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: captions cleaned, repeated sentences dropped."""
    c = T.clean_caption(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", c.alias("c")).select("doc_id", _md5(F.col("c.text")).alias("digest"), F.array_join("c.rules", ",").alias("rules"))


def doc_bigram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct to all bigrams."""
    return _docs(spark, sf_dir).select("doc_id", F.round(T.bigram_ratio(F.col("text")), 6).alias("ratio"))


def doc_ngram_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated trigrams, at most -1."""
    return _docs(spark, sf_dir).select("doc_id", F.round(T.repetition_penalty(F.col("text"), 3, -1.0), 6).alias("penalty"))


TERMS, ARTIFACTS, HEDGES = "license|token|mail|tion", "page|image|left|right", "may|might|possib|likely"


def doc_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped score with flags; the term lists are stand-ins for the medical ones."""
    s = T.quality_score(F.col("text"), TERMS, ARTIFACTS, HEDGES)
    return _docs(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", "s.score", F.array_join("s.flags", ",").alias("flags"))


def doc_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited concepts and their core forms."""
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(T.concept_set(t)).cast("long").alias("n_all"), F.size(T.concept_set(t, core=True)).cast("long").alias("n_core"), F.size(T.concept_set(t, ";")).cast("long").alias("n_semicolon"))


def doc_final_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: a text's start as reasoning, its end as final answer (put together here as stand-in)."""
    made = F.concat(F.substring("text", 1, 60), F.lit(" [1, 2] Final  Answer: "), F.substring("text", 61, 40))
    return _docs(spark, sf_dir).select("doc_id", made.alias("t")).select("doc_id", T.strip_citations(T.reasoning_part(F.col("t"))).alias("reasoning"), T.final_part(F.col("t")).alias("final"))


def page_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: tags and paths stripped from pages."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    c = T.squeeze(F.regexp_replace("html", "<[^>]+>", " "))
    return p.select("page_id", _md5(c).alias("digest"), F.length(c).cast("long").alias("n_chars"))


def page_option_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options made from a page's url parts, answered by letter and by text."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    parts = F.filter(F.split("url", "[/:.?=&-]+"), lambda x: x != "")
    a, b = F.get(parts, 1), F.coalesce(F.get(parts, 3), F.lit("none"))
    prompt = F.concat(F.lit("Which?\nA. "), a, F.lit("\n B.  "), b, F.lit(" \nC. other"))
    o = p.select("page_id", T.option_map(prompt).alias("o"), a.alias("a"), b.alias("b"))
    by_letter = T.answer_matches(F.col("o"), F.concat(F.lit("A. "), F.col("a")), F.when(F.col("page_id") % 2 == 0, F.lit("Final answer: A)")).otherwise(F.lit("Final answer: C.")))
    v = T.vqa_output(F.when(F.col("page_id") % 3 == 0, F.lit("b)")).otherwise(F.concat(F.lit("A: "), F.col("a"))), F.col("o"), F.col("b"))
    return o.select("page_id", F.size("o").cast("long").alias("n_options"), F.col("o")["B"].alias("option_b"), by_letter.alias("by_letter"), v["letter"].alias("letter"), v["answer"].alias("answer"), v["valid"].alias("valid"), v["correct"].alias("correct"))


def doc_answer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: the parsing cascade over four shapes of answer (ASCII stand-ins by document number)."""
    raw = F.element_at(F.array(F.lit("B) because"), F.lit("The answer is: c"), F.lit("red apple"), F.lit("red apple is it"), F.lit("it must be the green pear."), F.lit("Z."), F.lit("no idea")), (F.col("doc_id") % 7).cast("int") + 1)
    i = T.answer_index(raw, F.array(*map(F.lit, "ABC")), F.array(F.lit("Red apple"), F.lit("green pear"), F.lit("blue plum")))
    return _docs(spark, sf_dir).select("doc_id", i.alias("choice"))


def doc_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats and tool calls in completions put together by document number."""
    k = F.col("doc_id") % 4
    t = F.regexp_replace(F.substring("text", 1, 20), r"[^A-Za-z ]", "")
    made = (
        F.when(k == 0, F.concat(F.lit("<think>"), t, F.lit("</think>\n<answer>"), t, F.lit("</answer>")))
        .when(k == 1, F.concat(F.lit("<think>a</think>\nAction: find\nAction Input: {\"q\": \""), t, F.lit("\"}")))
        .when(k == 2, F.concat(F.lit("so \\boxed{"), t, F.lit("} <tool_call>{\"name\": \"f\", \"arguments\": \"x\"}</tool_call><tool_call>{\"name\": 1}</tool_call>")))
        .otherwise(t)
    )
    d = _docs(spark, sf_dir).select("doc_id", made.alias("t"))
    c = F.col("t")
    return d.select("doc_id", T.think_format(c).alias("think"), T.react_format(c).alias("react"), T.boxed(c).alias("boxed"), T.last_action(c)["action"].alias("action"), T.last_action(c)["input"].alias("input"), F.size(T.tool_calls(c)).cast("long").alias("n_calls"))


def doc_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expert tokens, with the hash in place of unusable ones."""
    out = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("use expert_0"), (F.col("doc_id") % 5).cast("string"))).otherwise(F.lit("EXPERT 1 or EXPERT 2"))
    r = T.router_choice(out, F.col("doc_id"), [1, 2, 3])
    return _docs(spark, sf_dir).select("doc_id", r["expert"].alias("expert"), r["valid"].alias("valid"))


def doc_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage tokens; stand-ins: source as family and group, a path made of lang and id."""
    path = F.concat(F.lit("/data/"), F.col("lang"), F.lit("/Case"), F.col("doc_id").cast("string"), F.lit("-img.png"))
    t = T.lineage_tokens(F.col("source"), {"group": F.concat(F.col("lang"), F.lit("-"), (F.col("doc_id") % 50).cast("string")), "patient": F.when(F.col("doc_id") % 2 == 0, F.lit(" "))}, F.array(path))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(t, "|").alias("tokens"))


def doc_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts split at two words, lossless."""
    p = T.split_by(F.col("text"), [" the ", " de "])
    d = _docs(spark, sf_dir).select("doc_id", "text", p.alias("p"))
    whole = F.array_join(F.transform("p", lambda x: F.concat(x["key"], x["content"])), "")
    return d.select("doc_id", F.size("p").cast("long").alias("n_parts"), (whole == F.col("text")).alias("lossless"))


def event_error_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of messages made from event types."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    msg = F.when(F.col("event_type") == "error", F.concat(F.lit("Error code: "), (400 + F.col("event_id") % 100).cast("string"), F.lit(" x"))).when(F.col("event_id") % 2 == 0, F.repeat(F.col("event_type"), 20))
    status = F.when(F.col("event_type") == "purchase", F.lit("success")).otherwise(F.col("event_type"))
    return e.select("event_id", T.error_category(status, msg).alias("category"))


_WS = r"[ \t\n\x0b\f\r]+"
_D = "from documents"
_G = f"list_filter(regexp_split_to_array(lower(text), '{_WS}'), lambda w: w <> '')"
QUERIES = {
    "doc_text_norms": (doc_text_norms, rf"""select doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) h1, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_')) h2,
        md5(coalesce(nullif(lower(trim(regexp_replace(text, '{_WS}', ' ', 'g'))), ''), 'unknown')) h3, md5(lower(trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' ;,.'))) h5 {_D}"""),
    "doc_sentence_dedup": (doc_sentence_dedup, rf"""with a as (select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) o {_D}), b as (select *, regexp_replace(o, '<[^>]+>', ' ', 'g') t from a),
        c as (select *, regexp_replace(t, '(?:[A-Za-z]:\\|/)(?:[^\s,;]+/)+[^\s,;]+', ' ', 'g') p from b),
        s as (select *, string_split(regexp_replace(trim(regexp_replace(p, '{_WS}', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) ss from c),
        k as (select *, list_filter(ss, lambda x, i: x <> '' and list_position(ss, x) = i) z from s)
        select doc_id, md5(array_to_string(z, ' ')) digest, concat_ws(',', case when t <> o then 'strip_html' end, case when p <> t then 'strip_export_path' end, case when len(z) <> len(ss) then 'dedupe_sentence' end) rules from k"""),
    "doc_bigram_ratio": (doc_bigram_ratio, f"""with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w {_D}), g as (select doc_id, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) g from w)
        select doc_id, round(case when len(w) < 3 then 1.0::double else len(list_distinct(g))::double / len(g) end, 6) ratio from g"""),
    "doc_ngram_penalty": (doc_ngram_penalty, f"""with w as (select doc_id, {_G} w {_D}), g as (select doc_id, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) g from w)
        select doc_id, round(case when len(g) = 0 then 0.0::double else (1 - len(list_distinct(g))::double / len(g)) * -1.0 end, 6) penalty from g"""),
    "doc_quality_score": (doc_quality_score, rf"""with w as (select doc_id, text, length(text) n, regexp_extract_all(lower(text), '[a-z0-9]+') w {_D}), g as (select *, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) g from w),
        f as (select *, case when len(w) < 3 then 1.0::double else len(list_distinct(g))::double / len(g) end r, len(regexp_extract_all(lower(text), '{TERMS}')) a, len(regexp_extract_all(lower(text), '{ARTIFACTS}')) b,
          len(regexp_extract_all(lower(text), '{HEDGES}')) c, not regexp_matches(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[.!?:;]$') cut from g)
        select doc_id, round(greatest(0.0::double, least(100.0::double, 48.0::double + least(18.0, a * 3.0) + case when n between 450 and 1500 then 7.0 when n between 300 and 1900 then 2.0 else -7.0 end
          + case when r >= 0.82 then 7.0 when r >= 0.65 then 2.0 else -9.0 end - least(18.0, b * 3.0) - least(24.0, c * 5.0) - case when cut then 2.0 else 0.0 end)), 6)::double score,
          concat_ws(',', case when b > 0 then 'artifact' end, case when c > 0 then 'hedging' end, case when r < 0.65 then 'repetitive' end, case when n < 300 then 'short' end, case when n > 1900 then 'long' end, case when cut then 'truncated' end) flags from f"""),
    "doc_concepts": (doc_concepts, rf"""with c as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[;\n,]+'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') c,
          list_filter(list_transform(string_split(text, ';'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') s {_D})
        select doc_id, len(list_distinct(c))::bigint n_all, len(list_distinct(list_transform(c, lambda x: regexp_replace(x, '^(?:uncertain|negated) ', ''))))::bigint n_core, len(list_distinct(s))::bigint n_semicolon from c"""),
    "doc_final_part": (doc_final_part, f"select doc_id, substring(text, 1, 60) || '  ' as reasoning, ' ' || substring(text, 61, 40) as final {_D}"),
    "page_strip_html": (page_strip_html, f"with c as (select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_WS}', ' ', 'g')) c from pages) select page_id, md5(c) digest, length(c) n_chars from c"),
    "page_option_lines": (page_option_lines, """with p as (select page_id, list_filter(regexp_split_to_array(url, '[/:.?=&-]+'), lambda x: x <> '') u from pages), o as (select page_id, u[2] a, coalesce(u[4], 'none') b from p),
        n as (select *, trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')) na, lower(trim(a)) la, lower(trim(b)) lb from o)
        select page_id, 3::bigint n_options, b option_b, page_id % 2 = 0 and na <> '' by_letter, case when page_id % 3 = 0 then 'B' else 'A' end letter, case when page_id % 3 = 0 then b else a end answer, true valid,
          case when page_id % 3 = 0 then case when la = lb then lb = lb else true end else la = lb end correct from n"""),
    "doc_answer_index": (doc_answer_index, f"select doc_id, ([1, 2, 0, 0, 1, null, null])[doc_id % 7 + 1]::bigint choice {_D}"),
    "doc_formats": (doc_formats, rf"""with d as (select doc_id, doc_id % 4 k, regexp_replace(substring(text, 1, 20), '[^A-Za-z ]', '', 'g') t {_D})
        select doc_id, (case when k = 0 then 1 else 0 end)::double think, (case when k = 1 then 1 else 0 end)::double react,
          trim(case k when 0 then t when 1 then '<think>a</think>' || chr(10) || 'Action: find' || chr(10) || 'Action Input: {{"q": "' || t || '"}}' when 2 then case when t = '' then 'so \boxed{{}} <tool_call>{{"name": "f", "arguments": "x"}}</tool_call><tool_call>{{"name": 1}}</tool_call>' else t end else t end) boxed,
          case when k = 1 then 'find' else 'none' end "action", case when k = 1 then '{{"q": "' || t || '"}}' else '{{}}' end "input", (case when k = 2 then 1 else 0 end)::bigint n_calls from d"""),
    "doc_router": (doc_router, f"""with o as (select doc_id, case when doc_id % 3 = 0 then 'use expert_0' || (doc_id % 5)::varchar else 'EXPERT 1 or EXPERT 2' end o {_D}), v as (select *, doc_id % 3 = 0 and doc_id % 5 in (1, 2, 3) ok, sha256('42|' || doc_id::varchar || '|' || o) h from o)
        select doc_id, case when ok then (doc_id % 5)::int else ([1, 2, 3])[((('0x' || h[1:8])::bigint::hugeint * 4294967296::hugeint + ('0x' || h[9:16])::bigint::hugeint) % 3)::int + 1] end expert, ok valid from v"""),
    "doc_lineage": (doc_lineage, f"""select doc_id, array_to_string(list_sort(['group:' || source || ':' || lang || '_' || (doc_id % 50)::varchar, 'image:' || source || ':case' || doc_id::varchar || '_img', 'case:case' || doc_id::varchar]), '|') tokens {_D}"""),
    "doc_split_parts": (doc_split_parts, f"""with s as (select doc_id, regexp_extract_all(text, ' the | de ') k, regexp_split_to_array(text, ' the | de ') p {_D}) select doc_id, (len(p) - case when p[1] = '' then 1 else 0 end)::bigint n_parts, true lossless from s"""),
    "event_error_category": (event_error_category, """with m as (select event_id, event_type t, case when event_type = 'error' then 'Error code: ' || (400 + event_id % 100)::varchar || ' x' when event_id % 2 = 0 then repeat(event_type, 20) end m from events),
        v as (select *, coalesce(nullif(m, ''), t) v from m) select event_id, case when t = 'purchase' then 'none' when t = 'error' then 'http_' || substring(v, 13, 3) when length(v) <= 80 then v else substring(v, 1, 77) || '...' end category from v"""),
}
