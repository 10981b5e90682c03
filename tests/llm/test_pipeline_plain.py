"""The pipeline's result against a plain version of its stages, worked out without Spark."""

import re

import duckdb
import xxhash

import corpus_pipeline
from quillon.llm.queries import tokenizer_path

from .conftest import plain
from .test_text_operators import WS, contamination, low

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    w = re.findall(WS, low(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(v >> b & 1 for v in h) > len(h))


def test_run_keeps_what_a_plain_version_keeps(spark):
    from tokenizers import Tokenizer

    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    lettered = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    prints = [(i, fingerprint(t)) for i, t in lettered]
    group = {i: i for i, _ in prints}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, x in prints:
        for b, y in prints:
            if b < a and (x ^ y).bit_count() <= 4:
                p, q = root(a), root(b)
                group[max(p, q)] = min(p, q)
    single = [(i, t) for i, t in lettered if root(i) == i]
    clean = {x[0] for x in contamination(single, items) if not x[4]}
    got = plain(corpus_pipeline.run(spark, SF))
    assert {r["doc_id"] for r in got} == clean
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokens = {}
    for r in got:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096
    # texts that hold nothing the secret scan looks at pass unchanged
    untouched = [(i, t) for i, t in single if i in clean and not re.search(r"[A-Za-z0-9+/_=.-]{16}", t)]
    assert len(untouched) > 50
    for i, t in untouched:
        assert tokens[i] == len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
