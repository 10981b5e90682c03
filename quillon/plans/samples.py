"""Queries of the sampling operators over documents, lineitem and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling as S


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *cols)


def doc_sample_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2,500 rows of the documents, copies and a remainder."""
    return S.sample_rows(_docs(spark, sf_dir), "doc_id", 2500)


def doc_train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a tenth for validation."""
    return S.train_val_split(_docs(spark, sf_dir), "doc_id", 0.1)


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "source").groupBy("source").agg(F.count("*").alias("n"))


def doc_quota_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """137 rows over sources in proportion."""
    return S.proportional_quota(_strata(spark, sf_dir), "source", "n", 137)


def doc_quota_waterfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """333 rows over sources by water level."""
    return S.waterfill_quota(_strata(spark, sf_dir), "source", "n", 333)


def doc_quota_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """333 rows over sources in equal shares."""
    return S.apportion(_strata(spark, sf_dir), "source", "n", 333)


def doc_stratified_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: 150 rows over languages, then sources."""
    return S.stratified_select(_docs(spark, sf_dir, "lang", "source"), "doc_id", "lang", "source", 150)


def doc_tiered_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 rows over languages in three tiers; stand-ins: n_chars as score, its last digit as hardness."""
    d = _docs(spark, sf_dir, "lang", "n_chars").withColumn("hard", F.col("n_chars") % 10)
    q = S.proportional_quota(d.groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 120)
    return S.tiered_select(d, "doc_id", "lang", "n_chars", "hard", q).select("doc_id", "lang", "tier")


def doc_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 rows, one of each source in turn."""
    return S.round_robin(_docs(spark, sf_dir, "source"), "doc_id", "source", 50)


def doc_round_robin_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the same with sources in hash order, and a second draw from the rest."""
    d = _docs(spark, sf_dir, "source")
    first = S.round_robin(d, "doc_id", "source", 30, 7, True)
    second = S.round_robin(d.join(first, "doc_id", "left_anti"), "doc_id", "source", 30, 8, True)
    return first.withColumn("draw", F.lit(1)).unionByName(second.withColumn("draw", F.lit(2)))


def doc_exclusive_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """long texts, then German ones, then any, 20 each, none twice."""
    d = _docs(spark, sf_dir, "lang", "n_chars")
    taken = None
    for name, test in (("long", F.col("n_chars") > 4000), ("german", F.col("lang") == "de"), ("any", F.lit(True))):
        pool = d.filter(test) if taken is None else d.filter(test).join(taken, "doc_id", "left_anti")
        got = pool.orderBy(S.hash_order(42, name, F.col("doc_id")), "doc_id").limit(20).select("doc_id", F.lit(name).alias("stratum"))
        taken = got if taken is None else taken.unionByName(got)
    return taken


def doc_shard_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven shards, the last incomplete round dropped."""
    return S.shards(_docs(spark, sf_dir), "doc_id", 7)


def doc_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """piece 2 of 7."""
    return S.slice_of(_docs(spark, sf_dir), "doc_id", 2, 7)


def doc_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English and other documents merged three to one until one side ends."""
    d = _docs(spark, sf_dir, "lang")
    return S.interleave(d.filter("lang = 'en'"), d.filter("lang <> 'en'"), "doc_id", 0.75).select("doc_id", "origin", F.round("_due", 6).alias("due"))


def doc_group_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources in hash order while fewer than 300 rows stand before them."""
    g = _strata(spark, sf_dir).withColumn("h", S.hash_order(42, "fill", F.col("source")))
    return S.prefix_fill(g, ["h", "source"], "n", 300).select("source", "n", "before")


def doc_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """three other sources for each document, from the pool of all sources."""
    d = _docs(spark, sf_dir, "source")
    return S.negatives(d, d.select(F.col("source").alias("item")), "doc_id", "source", "item", 3)


def doc_task_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """equal quotas of 1,000 rows over the sources."""
    return S.task_quotas(_docs(spark, sf_dir, "source").select("source"), "source", 1000)


def rl_best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per order the two best lines against the worst; stand-ins: discount as process reward, return flag as outcome."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_discount", "l_returnflag")
    return S.best_of_n(li, "l_orderkey", "line", F.col("l_discount"), (F.col("l_returnflag") == "R").cast("int"), 2).withColumn("score", F.round("score", 6))


_H = lambda p, k="doc_id", seed=42: f"sha256('{seed}|{p}|' || {k}::varchar)"
_S = "s as (select source, count(*) n from documents group by source)"


def _apportion(table: str, key: str, total: str, part: str = "") -> str:
    """SQL of an equal apportionment, by the loop-free level."""
    p = f"partition by {part}" if part else ""
    also = f"{part}, " if part else ""
    return f"""i0 as (select *, row_number() over ({p} order by n, {key}) i, count(*) over ({p}) k, coalesce(sum(n) over ({p} order by n, {key} rows between unbounded preceding and 1 preceding), 0) pre, {total} t from {table}),
    i1 as (select *, floor((t - pre) / (k - i + 1)::double) l from i0), i2 as (select *, min(case when n > l then i end) over ({p}) fi from i1), i3 as (select *, max(case when i = fi then l end) over ({p}) lev from i2),
    i4 as (select *, case when lev is null then n else least(n, lev) end q, coalesce(n > lev, false) op from i3), i5 as (select *, t - sum(q) over ({p}) lft, row_number() over (partition by {also}op order by {key}) r from i4),
    ap as (select * exclude (i, k, pre, t, l, fi, lev, q, op, lft, r), (q + case when op and r <= lft then 1 else 0 end)::bigint quota from i5)"""


QUERIES = {
    "doc_sample_oversample": (doc_sample_oversample, f"""with r as (select doc_id, row_number() over (order by {_H('sample')}, doc_id) rk, count(*) over () n from documents)
        select doc_id, unnest(range(1, (2500 // n + case when rk <= 2500 % n then 1 else 0 end + 1)::bigint)) as "copy" from r"""),
    "doc_train_val_split": (doc_train_val_split, f"""with r as (select doc_id, row_number() over (order by {_H('split')}, doc_id) rk, count(*) over () n from documents)
        select doc_id, case when rk <= greatest(floor(n * 0.1), 1) then 'val' else 'train' end split from r"""),
    "doc_quota_proportional": (doc_quota_proportional, f"""with {_S}, q as (select *, sum(n) over () t, 137 * n // sum(n) over () q, 137 * n % sum(n) over () m from s),
        r as (select *, 137 - sum(q) over () l, row_number() over (order by m desc, source) i from q) select source, n, (q + case when i <= l then 1 else 0 end)::bigint quota from r"""),
    "doc_quota_waterfill": (doc_quota_waterfill, f"""with {_S}, a as (select *, row_number() over (order by n, source) i, count(*) over () k, coalesce(sum(n) over (order by n, source rows between unbounded preceding and 1 preceding), 0) p from s),
        b as (select *, (333 - p) / (k - i + 1)::double l from a), v as (select l lev from b where n >= l order by i limit 1), c as (select b.*, lev, case when lev is null or n < lev then n else floor(lev) end q from b left join v on true),
        d as (select *, 333 - sum(q) over () lft, row_number() over (partition by n >= lev order by {_H('waterfill', 'source')}, source) r from c)
        select source, n, (q + case when n >= lev and r <= lft then 1 else 0 end)::bigint quota from d"""),
    "doc_quota_apportion": (doc_quota_apportion, f"with {_S}, {_apportion('s', 'source', '333')} select source, n, quota from ap"),
    "doc_stratified_select": (doc_stratified_select, f"""with cells as (select lang, source, count(*) n from documents group by all), tops as (select lang, sum(n)::bigint n from cells group by lang),
        qa as (with {_apportion('tops', 'lang', '150')} select lang, quota top from ap), cq as (select cells.*, top from cells join qa using (lang)), qb as (with {_apportion('cq', 'source', 'top', 'lang')} select lang, source, quota from ap),
        r as (select doc_id, lang, source, row_number() over (partition by lang, source order by {_H('stratified')}, doc_id) rk from documents) select doc_id, lang, source from r join qb using (lang, source) where rk <= quota"""),
    "doc_tiered_select": (doc_tiered_select, f"""with s as (select lang, count(*) n from documents group by lang), q as (select *, 120 * n // sum(n) over () q, 120 * n % sum(n) over () m from s),
        qq as (select lang, (q + case when row_number() over (order by m desc, lang) <= 120 - sum(q) over () then 1 else 0 end)::bigint quota from q),
        d as (select doc_id, lang, n_chars, n_chars % 10 hard, quota, quota * 7 // 10 hi, quota * 2 // 10 mid from documents join qq using (lang)),
        a as (select *, row_number() over (partition by lang order by n_chars desc, {_H('high')}, doc_id) <= hi ishi from d), b as (select *, not ishi and row_number() over (partition by lang, ishi order by {_H('diversity')}, doc_id) <= mid ismid from a),
        c as (select *, row_number() over (partition by lang, not ishi and not ismid order by hard desc, n_chars, {_H('hard')}, doc_id) r from b)
        select doc_id, lang, case when ishi then 'high' when ismid then 'diversity' else 'hard' end tier from c where ishi or ismid or r <= quota - hi - mid"""),
    "doc_round_robin": (doc_round_robin, f"""select doc_id, source, row_number() over (partition by source order by {_H('robin')}, doc_id) as round from documents order by round, source, doc_id limit 50"""),
    "doc_round_robin_hashed": (doc_round_robin_hashed, f"""with a as (select doc_id, source, row_number() over (partition by source order by {_H('robin', seed=7)}, doc_id) as round from documents order by round, {_H('stratum', 'source', 7)}, doc_id limit 30),
        b as (select doc_id, source, row_number() over (partition by source order by {_H('robin', seed=8)}, doc_id) as round from documents where doc_id not in (select doc_id from a) order by round, {_H('stratum', 'source', 8)}, doc_id limit 30)
        select *, 1 draw from a union all select *, 2 draw from b"""),
    "doc_exclusive_strata": (doc_exclusive_strata, f"""with a as (select doc_id from documents where n_chars > 4000 order by {_H('long')}, doc_id limit 20), b as (select doc_id from documents where lang = 'de' and doc_id not in (from a) order by {_H('german')}, doc_id limit 20),
        c as (select doc_id from documents where doc_id not in (from a) and doc_id not in (from b) order by {_H('any')}, doc_id limit 20)
        select doc_id, 'long' stratum from a union all select doc_id, 'german' from b union all select doc_id, 'any' from c"""),
    "doc_shard_ranks": (doc_shard_ranks, "with r as (select doc_id, row_number() over (order by doc_id) r, count(*) over () n from documents) select doc_id, (r - 1) % 7 shard from r where r <= n // 7 * 7"),
    "doc_slice": (doc_slice, "with r as (select doc_id, row_number() over (order by doc_id) r, count(*) over () n from documents) select doc_id from r where r between 2 * (n // 7) + 1 and 3 * (n // 7)"),
    "doc_interleave": (doc_interleave, """with r as (select doc_id, case when lang = 'en' then 'a' else 'b' end origin from documents), d as (select *, row_number() over (partition by origin order by doc_id) / case when origin = 'a' then 0.75::double else 0.25::double end due from r),
        e as (select min(m) e from (select max(due) m from d group by origin)) select doc_id, origin, round(due, 6) due from d, e where due <= e"""),
    "doc_group_fill": (doc_group_fill, f"with {_S}, b as (select *, coalesce(sum(n) over (order by {_H('fill', 'source')}, source rows between unbounded preceding and 1 preceding), 0)::bigint as before from s) select source, n, before from b where before < 300"),
    "doc_negatives": (doc_negatives, f"""with p as (select item, row_number() over (order by {_H('pool', 'item')}, item) pl from (select distinct source item from documents)), m as (select count(*) n from p),
        j as (select doc_id, source, n, unnest(range(1, least(n, 4) + 1)) j, ('0x' || substr({_H('negative')}, 1, 12))::bigint % n f from documents, m), r as (select doc_id, source, item, j from j join p on p.pl = (f + j - 1) % n + 1 where item is distinct from source)
        select doc_id, source, item, place from (select *, row_number() over (partition by doc_id order by j) place from r) where place <= 3"""),
    "doc_task_quotas": (doc_task_quotas, "with s as (select distinct source from documents), n as (select count(*) n from s) select source, (1000 // n + (row_number() over (order by source) <= 1000 % n)::int)::bigint quota from s, n"),
    "rl_best_of_n": (rl_best_of_n, """with a as (select l_orderkey, l_linenumber::bigint line, l_discount p, (l_returnflag = 'R')::int o, min(l_discount) over w lo, max(l_discount) over w hi, count(*) over w n from lineitem window w as (partition by l_orderkey)),
        b as (select *, case when lo = hi then case when lo = 0 then 0.0 else least(1.0, lo) end else (p - lo) / (hi - lo + 1e-5::double) end + o * 10.0 score from a),
        c as (select *, row_number() over (partition by l_orderkey order by score desc, line) place, last_value(line) over (partition by l_orderkey order by score desc, line rows between unbounded preceding and unbounded following) rejected from b)
        select l_orderkey, line, round(score, 6) score, place, rejected from c where place <= 2 and place < n"""),
}
