"""Many repeated rows, and very many turns without numbers: right, and in time near that of other rows."""

import collections
import time

from pyspark.sql import functions as F

from quillon.llm import chat, substring

from .conftest import plain
from .test_chat_and_pipeline import rendered
from .test_text_operators import counted, removed


def test_copies_of_two_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    pair = [(0, text), (1, "x " + text + " y"), (1, "other " + text[:90]), (2, "nothing of the kind")]
    want = removed(pair)

    def run(n):
        d = spark.createDataFrame([x for x in pair for _ in range(n)], "doc_id long, text string").repartition(4)
        began = time.perf_counter()
        got = counted(plain(substring.remove_repeats(d)), "doc_id", "n_words", "n_removed", "text")
        return got, time.perf_counter() - began

    for n in (1, 20, 1000):
        got, took = run(n)
        assert got == collections.Counter({k: v * n for k, v in want.items()})
    assert took < 40


def test_a_dialogue_of_very_many_turns_without_numbers(spark):
    n = 20_000
    d = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("role"), F.format_string("t%05d", "id").alias("text"))
    began = time.perf_counter()
    got = plain(chat.rotate(d))
    took = time.perf_counter() - began
    want = rendered([tuple(r) for r in d.collect()])
    assert {(1, r["speaker"]): (r["text"], [(s["from"], s["to"]) for s in r["spans"]]) for r in got} == want
    assert took < 30
