"""Queries of row functions whose columns can be made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rowfuncs as P
from .common import table


def _flat(df: DataFrame, *extra) -> DataFrame:
    return df.select(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("flat"), *extra)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def rows_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sentence pairs; the label is the size modulo 4, three being unknown."""
    p = _parts(spark, sf_dir).select(F.col("p_name").alias("sentence1"), F.col("p_type").alias("sentence2"), F.when(F.col("p_size") % 4 < 3, (F.col("p_size") % 4).cast("int")).alias("label"))
    return _flat(P.classify(p, ["neutral", "entailment", "contradiction"], "Natural Language Inference", True))


def rows_sts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a score, as text, and as pairs from 0.75 on."""
    p = _parts(spark, sf_dir).select(F.col("p_name").alias("sentence1"), F.col("p_type").alias("sentence2"), (F.col("p_size") / 50.0).alias("score"))
    a = _flat(P.similarity_text(p))
    return a.unionByName(_flat(P.sentence_pairs(p, 0.75)))


def rows_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as instructions; some inputs carry the mark, some answers the prefix."""
    k = F.col("p_partkey")
    p = _parts(spark, sf_dir).select(F.col("p_name").alias("instruction"), F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("输入："), "p_brand")).otherwise(F.col("p_brand")).alias("input"), F.when(k % 2 == 0, F.concat(F.lit("Answer:  "), "p_type")).otherwise(F.col("p_type")).alias("output"))
    return _flat(P.alpaca_zh(p)).unionByName(_flat(P.long_alpaca(p)))


def rows_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other part has context."""
    p = _parts(spark, sf_dir).select(F.col("p_name").alias("instruction"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("context"), F.col("p_type").alias("response"))
    return _flat(P.with_context(p))


def rows_sudoku(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids made of repeated keys."""
    g = F.substring(F.repeat(F.concat(F.col("p_partkey").cast("string"), F.lit(".5")), 41), 1, 81)
    return _flat(P.sudoku(_parts(spark, sf_dir).select(g.alias("query"), F.reverse(g).alias("response"))))


def rows_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of three parts: the last question has no answer and is left out."""
    t = F.concat(F.lit("\n\nHuman: "), F.col("p_name"), F.lit("\n\nAssistant: "), F.col("p_type"), F.lit("\n\nHuman: more"))
    return _flat(P.preference_dialogue(_parts(spark, sf_dir).select(F.regexp_replace(t, "^\n\n", "").alias("chosen"), F.regexp_replace(t, "^\n\n", "").alias("rejected"))))


def rows_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed questions and answers."""
    p = _parts(spark, sf_dir)
    a = P.text_to_sql(p.select(F.col("p_name").alias("sql_context"), F.col("p_type").alias("sql_prompt"), F.col("p_brand").alias("sql_explanation"), F.lit("select 1").alias("sql")))
    b = P.law(p.select(F.col("p_brand").alias("type"), F.col("p_name").alias("title"), F.col("p_type").alias("chapter1"), F.lit(None).cast("string").alias("chapter2"), F.lit("!").alias("chapter3"), F.lit("end").alias("response")))
    return _flat(a).unionByName(_flat(b))


def rows_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans of a part's name, overlapping for every third part."""
    k = F.col("p_partkey")
    span = lambda a, b: F.array(*[x.cast("double") for x in (a, b, F.lit(1), F.lit(2), F.lit(3), F.lit(4))])
    p = _parts(spark, sf_dir).select(F.col("p_name").alias("caption"), F.array(span(F.when(k % 3 == 0, 1).otherwise(4), F.lit(6)), span(F.lit(0), F.lit(3))).alias("ref_exps"))
    return _flat(P.tagged_spans(p))


_ST = "'Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.' || chr(10) || 'Sentence 1: ' || p_name || chr(10) || 'Sentence 2: ' || p_type || chr(10) || 'Similarity score: '"
QUERIES = {
    "rows_classify": (rows_classify, """select 'user:Task: Natural Language Inference' || chr(10) || 'Sentence1: ' || p_name || chr(10) || 'Sentence2: ' || p_type || chr(10) || 'Category: neutral, entailment, contradiction' || chr(10) || 'Output:' || chr(10) || 'assistant:' || (['neutral', 'entailment', 'contradiction'])[p_size % 4 + 1] flat from part where p_size % 4 < 3"""),
    "rows_sts": (rows_sts, f"select 'user:' || {_ST} || chr(10) || 'assistant:' || printf('%.1f', p_size / 50.0::double) flat from part union all select 'user:' || p_name from part where p_size / 50.0 >= 0.75"),
    "rows_alpaca": (rows_alpaca, """with p as (select p_name n, case p_partkey % 3 when 0 then '' when 1 then '输入：' || p_brand else p_brand end i, case when p_partkey % 2 = 0 then 'Answer:  ' || p_type else p_type end o, p_type t from part), z as (select *, case when starts_with(i, '输入：') then substring(i, 4) else i end j from p)
        select 'user:' || n || case when j <> '' then chr(10) || j else '' end || chr(10) || 'assistant:' || o flat from z union all select 'user:' || n || case when i <> '' then chr(10) || i else '' end || chr(10) || 'assistant:' || t from z"""),
    "rows_context": (rows_context, "select 'user:' || case when p_partkey % 2 = 0 then 'Here gives some useful information:' || chr(10) || p_brand || chr(10) else '' end || p_name || chr(10) || 'assistant:' || p_type flat from part"),
    "rows_sudoku": (rows_sudoku, """with g as (select substring(repeat(p_partkey::varchar || '.5', 41), 1, 81) g from part), l as (select replace(g, '.', '0') q, reverse(g) r from g)
        select 'user:Solve the following 9x9 Sudoku puzzle. Empty cells are marked with ''0''. Provide the completed grid as your answer.' || chr(10) || chr(10) || 'Puzzle:' || chr(10) || array_to_string([q[i * 9 + 1:i * 9 + 9] for i in range(0, 9)], chr(10)) || chr(10) || 'assistant:' || array_to_string([r[i * 9 + 1:i * 9 + 9] for i in range(0, 9)], chr(10)) flat from l"""),
    "rows_dialogue": (rows_dialogue, "select 'user:' || p_name || chr(10) || 'assistant:' || p_type flat from part"),
    "rows_sql": (rows_sql, """select 'user:Sql Table information:' || chr(10) || p_name || chr(10) || p_type || chr(10) || 'assistant:Let''s think step by step:' || chr(10) || p_brand || chr(10) || 'So the final sql is:' || chr(10) || 'select 1' flat from part
        union all select 'assistant:' || p_brand || chr(10) || p_name || chr(10) || p_type || '!end' from part"""),
    "rows_spans": (rows_spans, "select 'user:what is the proper caption of this image?' || chr(10) || 'assistant:<ref-object><bbox>' || substring(p_name, 4, 1) || '<ref-object><bbox>' || substring(p_name, 7) flat from part where p_partkey % 3 <> 0"),
}
