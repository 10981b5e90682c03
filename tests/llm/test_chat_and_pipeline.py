"""Chat rotation against a plain version; the pipeline against plain stages; removal of the folder."""

import collections
import os
import re
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import chat, language

from .conftest import plain

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rendered(table, size=256):
    """{(conversation, speaker): text, spans} of a plain rendering."""
    out = {}
    convs = collections.defaultdict(list)
    for c, t, r, x in table:
        convs[c].append((t is not None, t or 0, r or "unknown", x or ""))
    for c, turns in convs.items():
        turns.sort()
        for s in {r for _, _, r, _ in turns if r != "system"}:
            text, spans = "", []
            for _, _, r, x in turns:
                name = "system" if r == "system" else "assistant" if r == s else "user name=" + re.sub(r"[\r\n<>|]", "_", r)
                head, body = f"<|im_start|>{name}\n", f"{x}<|im_end|>\n"
                if r == s:
                    spans.append((len(text) + len(head), len(text) + len(head) + len(body)))
                text += head + body
            out[c, s] = (text, spans)
    return out


TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello é"), (1, 2, "assistant", "Hello é"), (1, 3, "bob|x", None), (2, 5, None, "who"), (2, None, "user", "first"),
    (3, 0, "system", "alone"), (None, 0, "user", "a"), (None, 1, "assistant", ""),
] + [(4, i, "ab"[i % 2], f"turn {i}") for i in range(50)] + [(5, i * i, ("system", "ann", "b", "a longer name")[i // 5], "é" * i) for i in range(20)]


def test_rotation(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    for size in (256, 7):
        got = collections.defaultdict(list)
        for r in plain(chat.rotate(df.repartition(3), turns_per_segment=size)):
            got[r["conv_id"], r["speaker"]].append(r)
        want = rendered(TURNS)
        assert got.keys() == want.keys()
        for k, parts in got.items():
            parts.sort(key=lambda r: r["segment"])
            assert "".join(p["text"] for p in parts) == want[k][0]
            assert [(p["char_start"] + a, p["char_start"] + b) for p in parts for a, b in ((s["from"], s["to"]) for s in p["spans"])] == want[k][1]
    assert chat.rotate(df.limit(0)).count() == 0


def test_pipeline_stages_keep_their_promises(spark, docs, tmp_path):
    """Each stage on the one before: columns of documents stay, decisions take effect, awkward rows don't break it."""
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = docs.select("doc_id", "text", "lang", "source", "n_chars").cache()
    now, seen = base, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now
        if name != "packing":
            assert now.columns == base.columns
    kept = collections.Counter(r["doc_id"] for r in seen["language_id"].collect())
    assert 4 not in kept and 11 not in kept and kept[1] == 1 and kept[6] == 2
    near = collections.Counter(r["doc_id"] for r in seen["simhash_near_dedup"].collect())
    assert near[6] == 1 and near[9] == 0 and near[8] == 1 and near[None] == 1
    clean = {r["doc_id"] for r in seen["benchmark_decontamination"].collect()}
    assert 6 not in clean and 5 in clean and 8 in clean
    texts = {r["doc_id"]: r["text"] for r in seen["secret_scan"].collect()}
    assert "[SECRET]" in texts[12] and set(texts) == clean
    assert {r["doc_id"] for r in seen["packing"].select("doc_id").collect()} == clean


def test_pipeline_near_dedup_tells_rows_by_text(spark):
    """Repeated ids with different texts, null ids and repeated rows: one row of each group stays, and no other group loses one."""
    t = [" ".join(f"{c}{i}" for i in range(40)) for c in "wxyz"]
    table = [(5, t[0], "a"), (5, t[1], "a"), (7, t[0], "b"), (8, t[1], "b"), (9, t[2], "a"), (9, t[2], "b"), (None, t[2], "a"), (None, t[3], "a"), (None, t[3], "b"), (3, t[0], None)]
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(table, "doc_id long, text string, source string"), "")
    assert got.columns == ["doc_id", "text", "source"]
    assert collections.Counter((r["doc_id"], r["text"]) for r in plain(got)) == collections.Counter([(3, t[0]), (5, t[1]), (9, t[2]), (None, t[3])])


def test_pipeline_run_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    cols = ["doc_id", "start", "length", "ids_crc32"]
    assert counter(got, cols) == counter(docs, cols)


def test_pipeline_empty(spark, empty, tmp_path):
    spark.createDataFrame([(1, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.count() == 0


def test_pipeline_keeps_texts_where_no_language_is_learnt(spark, docs):
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = [r["doc_id"] for r in corpus_pipeline.language_id(spark, base.withColumn("lang", F.lit(None).cast("string")), "").collect()]
    told = [r["doc_id"] for r in corpus_pipeline.language_id(spark, base, "").collect()]
    assert collections.Counter(kept) == collections.Counter(told) == collections.Counter([1, 5, 6, 6, None, 8, 9, 10, 12, 13, 14])
    held = base.filter("doc_id is not null").withColumn("lang", F.when(language.held_out("doc_id"), F.col("lang")))
    assert collections.Counter(r["doc_id"] for r in corpus_pipeline.language_id(spark, held, "").collect()) == collections.Counter(kept) - collections.Counter([None])
    # a label that reads like the mark of texts without letters
    assert collections.Counter(r["doc_id"] for r in corpus_pipeline.language_id(spark, base.withColumn("lang", F.lit(language.UNKNOWN)), "").collect()) == collections.Counter(kept)


def counter(df, cols):
    return collections.Counter(tuple(r) for r in df.select(*cols).collect())


def test_queries_match_their_sql(spark):
    """Registered queries with SQL, on the smallest tables."""
    import duckdb

    from quillon.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        mine = queries.queries()[name](spark, sf)
        cols = sorted(mine.columns)
        theirs = con.sql(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert counter(mine, cols) == collections.Counter(theirs), name


def test_entry_imports_without_this_folder(tmp_path):
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quillon.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, env=os.environ | {"PYTHONPATH": REPO})
