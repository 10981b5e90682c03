"""Queries of the attempt-log operators over events; `error` stands for a refused call, `purchase` for success, user for record id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons as J
from ..operators import attempts as A
from .common import table

_DAY = F.to_date  # of a timestamp column


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def event_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event in append order."""
    return A.latest(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def event_effective_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 20 users; the cycle is errors and purchases from 20 January on."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")
    cycle = (F.col("ts") >= F.lit("2024-01-28").cast("timestamp_ntz")) & F.col("event_type").isin("error", "purchase")
    return A.effective_latest(e, "user_id", "event_id", F.floor(F.col("user_id") / 20), cycle, F.col("event_type") == "purchase").select("user_id", "event_id", "event_type", "inherited")


def event_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of errors within a day."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("hit"), F.to_date("ts").alias("day"))
    return A.bursts(e, ["day"], ["ts", "event_id"], "hit", "user_id", "ts", minutes=60).filter("burst is not null").select("event_id", "burst")


def event_rolling_2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type in the trailing two hours."""
    return A.calls_in_window(_events(spark, sf_dir).select("event_id", "event_type", "ts"), ["event_type"], "ts", 7200).select("event_id", "in_window")


def event_batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of batches of 50 users."""
    e = _events(spark, sf_dir).withColumn("batch", F.floor(F.col("user_id") / 50))
    m = A.batch_metrics(e, "batch", "user_id", "event_type", "purchase", "value", "event_id")
    return m.withColumn("success_rate", F.round("success_rate", 6)).withColumn("amplification", F.round("amplification", 6))


def event_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed values of each user."""
    return A.debiased_ema(_events(spark, sf_dir), "user_id", "event_id", "value", 0.9).withColumn("ema", F.round("ema", 6))


def event_ema_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed value after each event of an event type, in event order."""
    e = _events(spark, sf_dir).select("event_type", "event_id", "value")
    return A.smoothed(e, ["event_type"], ["event_id"], "value", 0.9).select("event_id", F.round("ema", 6).alias("ema"))


def event_sessions_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sessions start at each purchase."""
    s = A.sessions(_events(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "purchase")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def event_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first error, told apart by its value."""
    e = _events(spark, sf_dir)
    err = F.col("event_type") == "error"
    return A.first_failure(e, "user_id", "event_id", [("costly", err & (F.col("value") > 50)), ("error", err)])


def event_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of 500 a user."""
    b = A.budget(_events(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], F.col("value"), 500.0)
    return b.select("event_id", F.round("spent", 4).alias("spent"), F.round("remaining", 4).alias("remaining"))


def event_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in props, and errors of concept answers built from it."""
    k = F.get_json_object("props", "$.k").cast("long")
    raw = F.when(k % 4 == 0, F.lit('{"concepts": ["a", "b"]}')).when(k % 4 == 1, F.lit('{"concepts": [" "]}')).when(k % 4 == 2, F.col("props")).otherwise(F.lit("{broken"))
    return _events(spark, sf_dir).select("event_id", k.alias("k"), J.concept_error(raw).alias("error"))


def event_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO text read back, and ten minutes later; unreadable ones are skipped."""
    iso = F.when(F.col("event_id") % 10 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    t = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return _events(spark, sf_dir).select("event_id", (F.unix_timestamp(t) + 600).alias("until")).filter("until is not null")


QUERIES = {
    "event_latest_state": (event_latest_state, "select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type, arg_max(value, event_id) as value from events group by user_id"),
    "event_effective_state": (event_effective_state, """with e as (select *, user_id // 20 b, ts >= '2024-01-28' and event_type in ('error', 'purchase') inc from events), s as (select b from e group by b having bool_or(inc)),
        c as (select user_id, max(event_id) id, arg_max(event_type, event_id) t from e where inc group by 1), a as (select user_id, any_value(b) b, max(event_id) id, arg_max(event_type, event_id) t from e group by 1)
        select a.user_id, coalesce(c.id, a.id) event_id, coalesce(c.t, a.t) event_type, c.id is null inherited from a left join c using (user_id) where a.b in (from s) and (c.id is not null or a.t = 'purchase')"""),
    "event_burst": (event_burst, """with e as (select event_id, user_id, ts, event_type = 'error' hit, ts::date d from events), w as (select *, hit and coalesce(lag(hit, 1) over o, false) and coalesce(lag(hit, 2) over o, false) r3, sum(hit::int) over (o rows between 19 preceding and current row) s,
        list({'h': hit, 'i': user_id, 't': ts}) over (o rows between 19 preceding and current row) l from e window o as (partition by d order by ts, event_id)),
        b as (select event_id, case when r3 then 'three_in_a_row' when s >= 5 then 'five_in_recent' when len(list_distinct(list_transform(list_filter(l, lambda x: x.h and x.t >= ts - interval 60 minute), lambda x: x.i))) >= 3 then 'several_ids' end burst from w) select * from b where burst is not null"""),
    "event_rolling_2h": (event_rolling_2h, "select event_id, count(*) over (partition by event_type order by epoch_us(ts) range between 7199999999 preceding and current row) in_window from events"),
    "event_batch_metrics": (event_batch_metrics, """with e as (select *, user_id // 50 batch from events), l as (select batch, user_id, arg_max(event_type, event_id) t, count(*) a from e group by all), s as (select batch, count(*) n_ids, sum(a)::bigint n_attempts, count(*) filter (t = 'purchase') n_success from l group by 1),
        p as (select batch, list(value order by value) v, count(*) n from e group by 1) select s.*, v[least(floor(n * 0.95::double), n - 1)::int + 1] p95, round(n_success / n_ids::double, 6) success_rate, round(n_attempts / n_ids::double, 6) amplification, n_success = n_ids complete from s join p using (batch)"""),
    "event_ema": (event_ema, "with r as (select *, row_number() over (partition by user_id order by event_id desc) - 1 k from events) select user_id, round(sum(value * pow(0.9::double, k)) / sum(pow(0.9::double, k)), 6) ema from r group by 1"),
    "event_ema_steps": (event_ema_steps, """with recursive e as (select event_type, event_id, value, row_number() over (partition by event_type order by event_id) i from events),
        r as (select event_type, event_id, i, value::double x, 1::double w from e where i = 1 union all select e.event_type, e.event_id, e.i, r.x * 0.9::double + value, r.w * 0.9::double + 1 from r join e on e.event_type = r.event_type and e.i = r.i + 1)
        select event_id, round(x / w, 6) ema from r"""),
    "event_sessions_by_flag": (event_sessions_by_flag, "with s as (select *, sum((event_type = 'purchase')::int) over (partition by user_id order by event_id)::bigint as session from events) select user_id, session, count(*) n, min(event_id) first_event from s group by all"),
    "event_first_failure": (event_first_failure, "select user_id, arg_min(case when value > 50 then 'costly' else 'error' end, event_id) reason, min(event_id) event_id from events where event_type = 'error' group by 1"),
    "event_budget": (event_budget, "select event_id, round(sum(value) over w, 4) spent, round(500 - sum(value) over w, 4) remaining from events window w as (partition by user_id order by event_id)"),
    "event_json_fields": (event_json_fields, """with k as (select event_id, (props->>'$.k')::bigint k from events) select event_id, k, case k % 4 when 0 then null when 1 then 'blank_concept' when 2 then 'missing_key' else 'invalid_json' end error from k"""),
    "event_cooldown": (event_cooldown, "select event_id, (epoch(date_trunc('second', ts))::bigint + 600) until from events where event_id % 10 <> 0"),
}
