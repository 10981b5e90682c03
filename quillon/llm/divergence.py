"""Divergence of sources within a language, from exact term counts.

Tasks count with Arrow's kernels inside mapInArrow: texts are lowered (ascii_lower),
cut at everything that is no letter (split_pattern_regex), terms become codes
(dictionary_encode), and two hash group_bys give, for each (lang, source, term), its
occurrences and its documents. These partial counts are merged by Spark. Columnar
shards of the merged counts (a range of terms, all sources of a block pair) then
give partial sums of |p - q|, and sums of the shards are the divergences.

A language keeps the terms in at least `least_docs` of its documents. A kept term's
share within a group is p = 1 + floor(scale * (count + add) / (N + add * V)), V the
language's kept terms, N the group's occurrences of these. All sums are integers;
the quotient is a decimal's integral one.

Shards hold about `shard_rows` counts and two blocks of about `block_sources`
sources, whatever the numbers of terms and sources: rows of a language of many
sources meet block by block. A source of a third of all rows is joined by a
broadcast of few hot groups, or shuffled after it was counted.

Cases: null text, lang or source are ''; a group without terms is a group; a
language that keeps no term has pairs of value 0 and no term rows; repeated rows
count as often as they stand; an empty table gives an empty result; other columns
and ids are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, small_batches, spread_join
from .textbytes import task_batches

#: Parts terms: all of ASCII but letters.
SEPARATOR = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text counted at once (a longer text alone), and counts a task merges and hands on at once.
SLICE_BYTES, HELD_ROWS = 4 << 20, 400_000
KEYS = ["lang", "source", "term"]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows, each of at most SLICE_BYTES of text or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, d) of a slice's rows, and a row of the term '' for each group."""
    text, lang, source = (pc.fill_null(batch.column(c), "") for c in ("text", "lang", "source"))
    lists = pc.split_pattern_regex(pc.ascii_lower(text), pattern=SEPARATOR)
    terms = pc.list_flatten(lists)
    real = pc.not_equal(terms, "")
    codes = terms.filter(real).dictionary_encode()
    by_doc = pa.table({"doc": pc.list_parent_indices(lists).filter(real), "term": codes.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    at = by_doc["doc"]
    named = pa.table({"lang": lang.take(at), "source": source.take(at), "code": by_doc["term"], "n": by_doc["count_all"]})
    found = named.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    counted = pa.table({"lang": found["lang"], "source": found["source"], "term": codes.dictionary.take(found["code"]), "n": found["n_sum"], "d": found["n_count"]})
    groups = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"]).aggregate([])
    none = pa.array(np.zeros(len(groups), np.int64))
    marks = pa.table({"lang": groups["lang"], "source": groups["source"], "term": pa.array([""] * len(groups), pa.string()), "n": none, "d": none})
    return pa.concat_tables([counted, marks])


def _merged(held: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(held).group_by(KEYS).aggregate([("n", "sum"), ("d", "sum")])
    return pa.table({**{k: t[k] for k in KEYS}, "n": t["n_sum"], "d": t["d_sum"]})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for batch in task_batches(batches):
        for own in _slices(batch, "text"):
            held.append(count_terms(own))
            rows += len(held[-1])
            if rows > HELD_ROWS:
                held = [_merged(held)]
                rows = len(held[0])
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches()


def partial_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents as tasks counted them; the term '' names each group."""
    own = docs.select(*[docs[c].cast("string").alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    return small_batches(own).mapInArrow(_count, "lang string, source string, term string, n long, d long")


def share(count: Column, total: Column, kept: Column, *, scale: int, add: int) -> Column:
    """1 + floor(scale * (count + add) / (total + add * kept)), exactly."""
    top = F.lit(scale).cast("decimal(12,0)") * (count + add).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, F.greatest(total + kept * add, F.lit(1)).cast("decimal(20,0)"))


def shard_distances(table: pa.Table) -> pa.Table:
    """(lang, a, b, part) of one shard: sums over its terms of |p_a - p_b| less that of the groups' shares of count 0; marks bring the latter times V."""
    lang, same = table["lang"][0], table["i"][0].as_py() == table["j"][0].as_py()
    marks = table.filter(pc.equal(table["term"], ""))
    names = sorted(zip(marks["block"].to_pylist(), (x.encode() for x in marks["source"].to_pylist()), marks["p"].to_pylist(), marks["kept"].to_pylist(), strict=True))
    place = {name: k for k, (_, name, _, _) in enumerate(names)}
    zero, kept, block = (np.array([x[c] for x in names], np.int64) for c in (2, 3, 0))
    counts = table.filter(pc.not_equal(table["term"], ""))
    codes = counts["term"].combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    shares = np.tile(zero, (len(codes.dictionary), 1))
    shares[codes.indices.to_numpy(), [place[x.encode()] for x in counts["source"].to_pylist()]] = counts["p"].to_numpy()
    a, b, value = [], [], []
    for k in range(len(names)):
        others = np.arange(k + 1, len(names)) if same else np.flatnonzero(block > block[k])
        if not len(others):
            continue
        none = np.abs(zero[others] - zero[k])
        far = np.abs(shares[:, others] - shares[:, k : k + 1]).sum(axis=0) - len(shares) * none
        a += [names[k][1].decode()] * len(others)
        b += [names[x][1].decode() for x in others.tolist()]
        value.append(far + kept[others] * none)
    return pa.table({"lang": pa.array([lang.as_py()] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "part": pa.array(np.concatenate(value) if value else np.zeros(0, np.int64))})


def audit(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, scale: int = 1_000_000_000, add: int = 5,
    top: int = 50, shard_rows: int = 8192, block_sources: int = 192,
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources ('pair'), and the `top` terms that a source has above its language ('term')."""
    counts = cut(partial_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    kept = cut(counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("docs")).filter(F.col("docs") >= least_docs))
    rows = cut(counts.filter("term != ''").join(kept.select("lang", "term", "total"), ["lang", "term"]).select(F.struct("lang", "source").alias("g"), "lang", "source", "term", "n", "total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("group_total"), F.count("*").alias("members"))
    named = counts.filter("term = ''").select("lang", "source")
    sized = named.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = named.join(sized, "lang").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["kept", "lang_total", "group_total", "members"]).withColumn("g", F.struct("lang", "source")).withColumn("blocks", F.ceil(F.col("sources") / block_sources))
    # shards of a language by its counts; they reach the counts with their group's totals
    shards = groups.groupBy("lang").agg(F.greatest(F.ceil(F.sum("members") / shard_rows), F.lit(1)).alias("shards"))
    groups = cut(groups.join(shards, "lang"))
    of = lambda count, total: share(count, F.col(total), F.col("kept"), scale=scale, add=add)
    known = groups.select("g", "kept", "lang_total", "group_total", "blocks", "shards", "members")
    shared = cut(spread_join(rows, known, "g", "members").select("lang", "source", "term", of(F.col("n"), "group_total").alias("p"), of(F.col("total"), "lang_total").alias("q"), "blocks", "shards"))

    above = shared.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    marks = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    own = F.pmod(F.xxhash64("source"), F.col("blocks"))
    marks = marks.select("lang", "source", F.lit("").alias("term"), of(F.lit(0).cast("long"), "group_total").alias("p"), F.when(F.col("shard") == 0, F.col("kept")).otherwise(0).alias("kept"), own.alias("block"), "blocks", "shard")
    placed = shared.select("lang", "source", "term", "p", F.lit(0).cast("long").alias("kept"), own.alias("block"), "blocks", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"))
    dealt = placed.unionByName(marks).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "source", "term", "p", "kept", "block", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "shard")
    half = dealt.groupBy("lang", "i", "j", "shard").applyInArrow(shard_distances, "lang string, a string, b string, part long")
    far = half.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    both = far.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)


#: {docs}: the table.
SQL = r"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from {docs}),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
k as (select lang, term, count(*) total from w group by lang, term having count(distinct r) >= 30),
g as (select distinct lang, source from d),
v as (select g.lang, source, coalesce(kept, 0) kept, coalesce(lt, 0) lt from g left join (select lang, count(*) kept, sum(total) lt from k group by lang) x on g.lang = x.lang),
c as (select lang, source, term, count(*) n from w join k using (lang, term) group by all),
s as (select lang, source, sum(n) gt from c group by all),
p as (select v.lang, v.source, k.term, coalesce(n, 0) n,
  1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (coalesce(gt, 0) + 5 * kept)::hugeint p, 1 + (1000000000::hugeint * (total + 5)) // (lt + 5 * kept)::hugeint q
  from v join k on v.lang = k.lang left join c on c.lang = v.lang and c.source = v.source and c.term = k.term left join s on s.lang = v.lang and s.source = v.source),
x as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
u as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint "value" from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
select lang, source, part, item, "value", rank::int rank from (select *, row_number() over (partition by lang, source, part order by "value" desc, item) rank from u) where part = 'pair' or rank <= 50
"""
