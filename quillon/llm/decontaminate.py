"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Every benchmark item is cut into windows of `window` consecutive words (a shorter
item is one window). A window is the set of its `shingle`-word shingles with their
places. To contain a window a document must hold all of them, so of the shingles
in order of rarity a prefix of one is necessary: the rarest. Rarity is counted
over all documents. Documents are probed for that shingle alone; the place of the
shingle in the window and the document's length bound where the window may start;
the window's words are then compared exactly.

The benchmark's tables are broadcast while they have at most `broadcast_rows`
rows. Beyond that, positions and shingles are joined by a shuffle and the
candidates meet their documents again for the exact comparison.

Cases: a null text has no words and no hits; a null or wordless item has no
window; equal windows of several items count for each item; repeated rows each
get their own result; a null id is kept; empty tables give empty or clean
results; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Parts words: all of ASCII but digits and small letters (after A-Z are lowered).
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: A-Z lowered, parted at ASCII characters other than letters and digits."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATOR), ""), F.array().cast("array<string>"))


def _hash(w: str, place: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(w, place + i) for i in range(size)])


def benchmark_windows(items: DataFrame, window: int, shingle: int, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win, n, size, items, shingles): distinct windows, their items, and their shingles with places."""
    w = items.select(items[id_col].cast("string").alias("item"), words(items[text_col]).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    distinct = each.groupBy("win").agg(F.collect_set("item").alias("items"))
    size = F.least(F.size("win"), F.lit(shingle))
    sized = distinct.select("win", F.size("win").alias("n"), size.alias("size"), "items")
    by_size = F.lit(None).cast("long")
    for s in range(1, shingle + 1):
        by_size = F.when(F.col("size") == s, _hash("win", F.col("at"), s)).otherwise(by_size)
    placed = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))).alias("at"))
    return placed.select("win", "n", "size", "items", "at", by_size.alias("h"))


def _probes(own: DataFrame, sizes: list[int]) -> DataFrame:
    """Each word place of each document with the hash of the shingle that starts there (one row a shingle size)."""
    placed = own.select(*own.columns, F.posexplode("w").alias("p", "_word"))
    if len(sizes) == 1:
        return placed.select(*own.columns, "p", _hash("w", F.col("p"), sizes[0]).alias("h"))
    return placed.select(*own.columns, "p", F.explode(F.array(*[_hash("w", F.col("p"), s) for s in sizes])).alias("h"))


def hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, shingle: int = 4, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc, key, start, n, items): every occurrence of a benchmark window; key is the text's hash."""
    own = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("key"), words(docs[text_col]).alias("w"))
    table = cut(benchmark_windows(items, window, shingle))
    sizes = sorted(r[0] for r in table.select("size").distinct().collect()) or [shingle]
    tokens = table.select("h").distinct()
    small = table.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda x: x)
    seen = _probes(own, sizes).select("h").join(hint(tokens), "h").groupBy("h").agg(F.count("*").alias("seen"))
    rarity = cut(seen)  # a row for each shingle of the benchmark at most
    ranked = table.join(rarity, "h", "left").select("*", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("h"), F.col("at")).alias("rank"))
    prefix = ranked.groupBy("win").agg(F.min("rank").alias("r"), F.first("n").alias("n"), F.first("items").alias("items"))
    prefix = prefix.filter("r.seen > 0")
    prefix = prefix.select("win", "n", "items", F.col("r.h").alias("h"), F.col("r.at").alias("at"))
    start = F.col("p") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.size("w"))
    if small:
        found = _probes(own, sizes).join(F.broadcast(prefix), "h").filter(fits & (F.slice("w", start + 1, F.col("n")) == F.col("win")))
        return found.select("doc", "key", start.alias("start"), "n", "items")
    bounded = _probes(own.withColumn("size", F.size("w")), sizes).select("doc", "key", "size", "p", "h").join(prefix, "h")
    near = bounded.filter((start >= 0) & (start + F.col("n") <= F.col("size"))).select("doc", "key", start.alias("start"), "n", "items", "win")
    per_doc = near.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "n", "items", "win")).alias("c"))
    both = own.alias("o").join(per_doc.alias("d"), F.expr("o.doc <=> d.doc and o.key <=> d.key")).select("o.doc", "o.key", "w", F.explode("c").alias("c"))
    exact = both.filter(F.slice("w", F.col("c.start") + 1, F.col("c.n")) == F.col("c.win"))
    return exact.select("doc", "key", "c.start", "c.n", "c.items").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, shingle: int = 4, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, key, n_words, n_hit, items, contaminated) of every row; contaminated: hit words are at least 1 in 20."""
    found = hits(docs, items, id_col=id_col, text_col=text_col, window=window, shingle=shingle, broadcast_rows=broadcast_rows)
    places = F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("n") - 1)))
    per_doc = found.groupBy("doc", "key").agg(F.size(F.array_distinct(places)).cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    own = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("key"), F.size(words(docs[text_col])).cast("long").alias("n_words"))
    both = own.alias("o").join(per_doc.alias("h"), F.expr("o.doc_id <=> h.doc and o.key <=> h.key"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select(
        "doc_id", F.col("o.key"), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from {docs}),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select item_id, w[i:least(i + 12, len(w))] x from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from iw where len(w) > 0)),
lens as (select distinct len(x) n from win),
pos as (select doc_id, n, p, w[p:p + n - 1] x from (select doc_id, w, unnest(range(1, len(w) + 1)) p from dw), lens where p + n - 1 <= len(w)),
hit as (select distinct doc_id, p, n, item_id from pos join win using (x)),
cov as (select doc_id, count(distinct q)::bigint n_hit from (select doc_id, unnest(range(p, p + n)) q from hit) group by doc_id),
its as (select doc_id, count(*)::bigint n_items, string_agg(i, ',' order by i) s from (select distinct doc_id, item_id::varchar i from hit) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from dw d left join cov using (doc_id) left join its using (doc_id)
"""
