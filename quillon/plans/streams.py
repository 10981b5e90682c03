"""Streaming queries, run over what the table holds and returned as a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conversation import rotate_in_batches
from ..operators.joins import last_write
from ..streaming import resume as R
from ..streaming import stateful as T
from ..streaming import streams as L
from .common import checkpoint_folder, table


def _scratch(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, df: DataFrame, where: str, batches: int) -> DataFrame:
    """df written as files and read as a stream: one file a micro-batch, or all files in one micro-batch of many tasks."""
    (df.repartition(batches) if batches > 1 else df).write.parquet(f"{where}/in")
    return L.read_files(spark, f"{where}/in", df.schema, 1 if batches > 1 else (1 << 31) - 1)


def stream_pack_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: packs of documents in four micro-batches, an open bin carried over; the last open bins come out at the end."""
    where = _scratch(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("shard"), F.ceil(F.col("n_chars") / 4).alias("len"))
    L.run_available(L.packed(_stream(spark, d, where, 4), "shard", "doc_id", "len", 2048), f"{where}/out", f"{where}/state")
    done = spark.read.schema("shard long, pack long, member long, length long").parquet(f"{where}/out")
    return done.unionByName(L.open_packs(spark, f"{where}/state"))


def stream_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of errors by user (one micro-batch, so that order is the log's)."""
    where = _scratch(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("hit"))
    L.run_available(L.bursts(_stream(spark, e, where, 1), "user_id", "event_id", "hit"), f"{where}/out", f"{where}/state")
    return spark.read.schema("key string, place long, burst string").parquet(f"{where}/out")


def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of event types; the days that the watermark has closed."""
    where = _scratch(spark)
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    L.run_available(L.windowed(_stream(spark, e, where, 1), "ts", "event_type", "1 day"), f"{where}/out", f"{where}/state")
    out = spark.read.schema("start timestamp, event_type string, n long").parquet(f"{where}/out")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of event types with gaps of an hour, in three micro-batches; those that the watermark has closed."""
    where = _scratch(spark)
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    for b in range(3):
        e.filter(third == b).write.mode("append").parquet(f"{where}/in")
        L.run_available(L.sessions(L.read_files(spark, f"{where}/in", e.schema, 1 << 20), "ts", "event_type", "1 hour"), f"{where}/out", f"{where}/state")
    out = spark.read.schema("start timestamp, end timestamp, event_type string, n long").parquet(f"{where}/out")
    return out.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "event_type", "n")


def stream_head_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 documents, a tenth for validation."""
    val, train = L.head_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 0.1)
    return val.withColumn("split", F.lit("val")).unionByName(train.withColumn("split", F.lit("train")))


def stream_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three rules over groups of users, in three micro-batches of ten days; the state carries the rows before."""
    where = _scratch(spark)
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("team"), "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("hit"))
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    for b in range(3):
        e.filter(third == b).write.mode("append").parquet(f"{where}/in")
        L.run_available(T.limiter(L.read_files(spark, f"{where}/in", e.schema, 1 << 20), "team", "ts", "event_id", "hit", "user_id", minutes=60), f"{where}/out", f"{where}/state")
    return spark.read.schema("key string, place long, burst string").parquet(f"{where}/out")


def stream_batch_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: rows take the value before them within their batch of eight, in three micro-batches, all of which are run twice."""
    where = _scratch(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    for b in range(3):
        d.filter(F.floor(F.col("doc_id") / 8) % 3 == b).coalesce(1).write.mode("append").parquet(f"{where}/in")
    for run in ("first", "again"):  # the second run has lost its checkpoint, so every batch comes once more
        L.each_batch_once(L.read_files(spark, f"{where}/in", d.schema), lambda x: rotate_in_batches(x, "doc_id", "lang", 8), f"{where}/out", f"{where}/{run}")
    return spark.read.parquet(f"{where}/out").select("doc_id", "lang", "rotated", (F.col("batch") >= 0).alias("numbered"))


def stream_buffer_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents of four shards through a buffer of 64 rows, in two micro-batches; what is held at the end follows."""
    where = _scratch(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(4)).alias("shard"))
    middle = d.agg(F.avg("doc_id")).first()[0] or 0
    for late in (False, True):
        d.filter((F.col("doc_id") > middle) if late else (F.col("doc_id") <= middle)).write.mode("append").parquet(f"{where}/in")
        L.run_available(T.buffer_shuffled(L.read_files(spark, f"{where}/in", d.schema, 1 << 20), "shard", "doc_id", 64), f"{where}/out", f"{where}/state")
    return spark.read.schema("shard long, id long, place long").parquet(f"{where}/out").unionByName(T.still_held(spark, f"{where}/state"))


def log_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event from a log of segments: built, found unchanged, extended by a segment, and rebuilt after one was altered."""
    where = _scratch(spark)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    day = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).alias("k"))
    part = lambda k: day.filter(F.col("k") == k).drop("k")
    read = lambda names: spark.read.schema(e.schema).parquet(*([f"{where}/log"] if names is None else [f"{where}/log/{n}" for n in names]))
    fold = lambda rows: last_write(rows, ["user_id"], "event_id")
    go = lambda: R.resume(spark, f"{where}/log", f"{where}/state", read, fold, "latest")
    steps = []
    for k in (0, 1):
        part(k).coalesce(1).write.mode("append").parquet(f"{where}/log")
    steps += [go()[0], go()[0]]
    part(2).coalesce(1).write.mode("append").parquet(f"{where}/log")
    steps.append(go()[0])
    part(2).withColumn("event_type", F.lit("altered")).coalesce(1).write.mode("overwrite").parquet(f"{where}/new")
    first = part(0).unionByName(part(1)).coalesce(1)
    first.write.mode("overwrite").parquet(f"{where}/old")
    spark.read.parquet(f"{where}/new").unionByName(spark.read.parquet(f"{where}/old")).write.mode("overwrite").parquet(f"{where}/log")
    status, state = go()
    return state.select("user_id", "event_id", "event_type").withColumn("steps", F.lit(",".join([*steps, status])))


QUERIES = {
    "stream_pack_carry": (stream_pack_carry, None),
    "stream_burst": (stream_burst, """with w as (select user_id::varchar as key, event_id as place, event_type = 'error' h, sum((event_type = 'error')::int) over (partition by user_id order by event_id rows between 2 preceding and current row) s3, sum((event_type = 'error')::int) over (partition by user_id order by event_id rows between 19 preceding and current row) s20 from events)
        select key, place, case when s3 = 3 then 'three_in_a_row' else 'five_in_recent' end burst from w where s3 = 3 or s20 >= 5"""),
    "stream_limiter": (stream_limiter, """with e as (select event_id, user_id % 4 team, user_id, ts, event_type = 'error' hit from events), w as (select *, hit and coalesce(lag(hit, 1) over o, false) and coalesce(lag(hit, 2) over o, false) r3, sum(hit::int) over (o rows between 19 preceding and current row) s,
        list({'h': hit, 'i': user_id, 't': ts}) over (o rows between 19 preceding and current row) l from e window o as (partition by team order by ts, event_id)),
        b as (select team::varchar as key, event_id as place, case when r3 then 'three_in_a_row' when s >= 5 then 'five_in_recent' when len(list_distinct(list_transform(list_filter(l, lambda x: x.h and x.t >= ts - interval 60 minute), lambda x: x.i))) >= 3 then 'several_ids' end burst from w) select * from b where burst is not null"""),
    "stream_batch_shift": (stream_batch_shift, "select doc_id, lang, coalesce(lag(lang) over w, last_value(lang) over (partition by doc_id // 8 order by doc_id rows between unbounded preceding and unbounded following)) rotated, true numbered from documents window w as (partition by doc_id // 8 order by doc_id)"),
    "stream_buffer_shuffle": (stream_buffer_shuffle, """with d as (select doc_id id, doc_id % 4 shard, row_number() over (partition by doc_id % 4 order by doc_id) - 1 i, ('0x' || substring(sha256('42|exchange|' || doc_id), 1, 12))::bigint / pow(16, 12) u from documents)
        select shard, id, row_number() over (partition by shard order by i + 64 * u, id) - 1 place from d"""),
    "log_resume": (log_resume, """with e as (select user_id, event_id, case when least((day(ts) - 1) // 10, 2) = 2 then 'altered' else event_type end event_type from events)
        select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type, 'BUILT,READY,EXTENDED,REBUILT' steps from e group by 1"""),
    "stream_window": (stream_window, "select strftime(ts::date, '%Y-%m-%d') as day, event_type, count(*) n from events group by 1, 2 having max(ts)::date + interval 1 day <= (select max(ts) from events) - interval 10 minute"),
    "stream_sessions": (stream_sessions, """with g as (select ts, event_type, coalesce(ts >= lag(ts) over w + interval 1 hour, true)::int opens from events window w as (partition by event_type order by ts)),
        s as (select *, sum(opens) over (partition by event_type order by ts) k from g)
        select epoch_us(min(ts)) start_us, epoch_us(max(ts)) + 3600000000 end_us, event_type, count(*) n from s group by event_type, k having max(ts) + interval 1 hour <= (select max(ts) from events) - interval 10 minute"""),
    "stream_head_split": (stream_head_split, "select doc_id, case when row_number() over (order by doc_id) <= 10 then 'val' else 'train' end split from documents order by doc_id limit 100"),
}
