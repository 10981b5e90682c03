"""Steps that were right on small tables and slow or wrong on large ones."""

import math

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import attempts as A
from quillon.operators import rewards as R
from quillon.operators import rowfuncs as P
from quillon.operators import selection as S
from quillon.operators import stats as ST


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_out_rows_are_not_broadcast(spark):
    rows = spark.range(50).select(F.col("id").alias("k"), F.array(F.concat(F.lit("a"), F.col("id") % 7), F.lit("b")).alias("response"))
    out = P.caption_rerank(rows, "k", 3)
    plan = _plan(out)
    assert "LeftOuter" in plan and not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "LeftOuter" in line]
    assert "BuildLeft" not in plan  # only the pool may be broadcast, never the rows
    assert {len(r["negative_messages"]) for r in out.collect()} == {3}


def test_an_empty_answer_is_an_answer(spark):
    got = spark.range(1).select(T.boxed(F.lit("<think></think>\n<answer></answer>")).alias("a"), T.boxed(F.lit("<answer> \n</answer>")).alias("b"), T.boxed(F.lit(" no answer ")).alias("c")).first()
    assert (got["a"], got["b"], got["c"]) == ("", "\n", "no answer")


def test_a_constant_has_no_correlation_however_partials_merge(spark):
    # 49 * (1 / 49) is not 1: the mean of a partial of 49 rows merged into an empty one
    df = spark.range(0, 49 * 5, 1, 5).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("one"))
    assert ST.pearson(df, ["g"], "x", "one").first()["pearson"] is None
    assert ST.spearman(df, ["g"], "x", "one").first()["spearman"] is None
    assert abs(ST.pearson(df.withColumn("y", F.col("x") * 2), ["g"], "x", "y").first()["pearson"] - 1) < 1e-12


def test_rolling_counts_come_from_running_sums(spark):
    rows = [(i, "ab"[i % 2] if i % 7 else None, (i * i * 37) % 400 if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = A.calls_in_window(df, ["g"], "ts", 60, rows_per_part=50)
    assert "RangeFrame" not in _plan(out)  # a frame that slides is summed anew for each row
    want = {i: sum(h == g and t is not None and s - 60 < t <= s for _, h, t in rows) if s is not None else 0 for i, g, s in rows}
    assert {r["id"]: r["in_window"] for r in out.collect()} == want


def test_the_entropy_quantile_is_dealt_out(spark):
    rows = [("ab"[i % 2], float((i * 37) % 101) if i % 13 else None) for i in range(400)] + [("c", None), ("d", 5.0)]
    df = spark.createDataFrame(rows, "g string, e double")
    out = R.entropy_mask(df, ["g"], "e", 0.2, rows_per_part=40)
    assert "percentile" not in _plan(out)
    edge = {}
    for g in "abd":
        v = sorted(e for h, e in rows if h == g and e is not None)
        at = 0.8 * (len(v) - 1)
        edge[g] = v[int(at)] + (v[math.ceil(at)] - v[int(at)]) * (at - int(at)) if len(v) > 1 else v[0]
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r["kept"] is None if r["e"] is None else r["kept"] == (r["e"] >= edge[r["g"]]) for r in got)


def test_evidence_pairs_are_told_once_and_never_shuffled(spark):
    rows = [(i, "xy"[i % 2] if i % 17 else None, "test" if i % 3 == 0 else "train", str(i % 9) if i % 10 else None, [t for k, t in ((2, "p"), (3, "q"), (5, "r"), (7, None)) if i % k == 0] + ["p"] * (i % 4 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, s string, d string, t array<string>")
    out = S.evidence_pairs(df, "g", "id", "s", "d", "t", block=5)
    want = set()
    for i, g, s, d, t in rows:
        for j, h, r, e, u in rows:
            same, n = d is not None and d == e, len((set(t) & set(u)) - {None})
            if g is not None and g == h and (s, r) == ("train", "test") and (same or n):
                want.add((g, i, j, same, n))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "HashAggregate" not in _plan(out)


def test_audits_read_a_caption_once(spark):
    from quillon.operators import concepts as K

    df = spark.range(1).select(F.lit("No mass. A cyst.").alias("t"), F.lit("CT").alias("m"), F.array(*[F.struct(F.lit(n).alias("canonical"), F.lit("finding").alias("type"), F.lit("present").alias("status"), F.lit("").alias("laterality"), F.lit(n).alias("mention")) for n in ("mass", "cyst", "mass")]).alias("c"))
    counted = K.repair_counts(df.select(K.audit_reasons(F.col("c"), F.col("t"), F.col("m")).alias("r")), "r")
    assert {(r["reason"], r["n"]) for r in counted.collect()} == {("exact_duplicate", 1), ("negation_inconsistency", 2)}
    assert "Filter (size" not in counted._jdf.queryExecution().optimizedPlan().toString()  # the list would be made twice


def test_formats_of_one_layout_are_read_once_and_short_rows_are_dealt_out(spark):
    from quillon.operators import agents
    from quillon.plans.common import dealt

    shared = agents.shared_layouts()
    assert sorted(k for keys in shared for k in keys) == sorted(agents.LAYOUTS) and len(shared) == len(set(agents.LAYOUTS.values())) < len(agents.LAYOUTS)
    assert dealt(spark.range(0, 95, 1, 1), "id", 10).rdd.getNumPartitions() == 10 and dealt(spark.range(0), "id").count() == 0


def test_a_batch_of_calls_is_held_as_numbers():
    import pandas as pd

    from quillon.streaming import stateful

    frames = [pd.DataFrame({"us": [3, 1], "place": [0, 1], "hit": [True, False], "ident": ["b", None]}), pd.DataFrame({"us": [2], "place": [2], "hit": [None], "ident": ["b"]})]
    us, place, hit, ident, names = stateful.compact(iter(frames))
    assert sum(x.itemsize for x in (us, place, hit, ident)) == 21
    assert (us.tolist(), place.tolist(), hit.tolist(), [names[i] for i in ident]) == ([3, 1, 2], [0, 1, 2], [True, False, False], ["b", None, "b"])


def test_rouge_takes_one_pass_of_python(spark):
    from quillon import registry

    assert _plan(registry.queries()["doc_rouge"](spark, "/root/testdata/sf0.001")).count("text_scores") == 0
    from quillon.operators import metrics as M

    got = spark.createDataFrame([("a b a c", "a b c c"), ("", "a"), ("a", "b")], "a string, b string").select(M.rouge_and_bleu("a", "b").alias("s"), M.rouge_l("a", "b").alias("l"), M.text_scores("a", "b").alias("t")).collect()
    assert all(r["s"]["rouge_l"] == r["l"] and tuple(r["s"])[1:] == tuple(r["t"]) for r in got)


def test_a_caption_is_cleaned_in_one_pass(spark):
    from quillon import registry

    assert _plan(registry.queries()["doc_sentence_dedup"](spark, "/root/testdata/sf0.001")).count("regexp_replace(") == 3  # tags, paths, white space
    texts = [None, "", " \n", "<" * 300_000, "a < b <i>c</i> > d <", "see C:\\x/y.png, /a/b/c.png.\u00a0", "Hi. Hi.\n\nHo! <br>Hi. \u3000"]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.clean_caption("t").alias("c")).collect()
    assert [tuple(r["c"]) for r in sorted(got)] == [
        (None, []), ("", ["dedupe_sentence"]), ("", ["dedupe_sentence"]), ("<" * 300_000, []),
        ("a c > d <", ["strip_html"]), ("see ,", ["strip_export_path"]), ("Hi. Ho!", ["strip_html", "dedupe_sentence"]),
    ]


def test_facts_of_a_quality_score_are_found_once(spark):
    from quillon import registry

    plan = _plan(registry.queries()["doc_quality_score"](spark, "/root/testdata/sf0.001"))
    assert plan.count("lower(") == 1 and plan.count("regexp_extract_all(") == 4  # words and three counts
    texts = [None, "", "License likely. left page", "tion token mail mail: \n", "a b a b a b a b;\u2028", "Mayhap may MIGHT? "]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.quality_score("t", "license|token|mail|tion", "page|left", "may|might|likely").alias("s"), T.quality_score("t", "tion|to.en", "zz", "h+").alias("u")).collect()
    assert [(r["s"]["score"], ",".join(r["s"]["flags"])) for r in sorted(got)] == [
        (8.0, ""), (46.0, "short,truncated"), (38.0, "artifact,hedging,short,truncated"), (60.0, "short"), (30.0, "repetitive,short,truncated"), (33.0, "hedging,short"),
    ]
    assert sorted(got)[3]["u"]["score"] == 54.0  # terms that are no plain letters
