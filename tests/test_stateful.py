"""Streams with state and timers, and resumption checked against digests."""

import pytest
from pyspark.sql import functions as F

from quillon.operators.joins import last_write
from quillon.streaming import resume as R
from quillon.streaming import stateful as T
from quillon.streaming import streams as L


def feed(spark, where, rows, schema, make):
    d = spark.createDataFrame(rows, schema)
    d.coalesce(1).write.mode("append").parquet(f"{where}/in")
    L.run_available(make(L.read_files(spark, f"{where}/in", d.schema, 1 << 20)), f"{where}/out", f"{where}/state")


def test_limiter_forgets_idle_keys(spark, tmp_path):
    make = lambda s: T.limiter(s.withColumn("ts", F.timestamp_seconds("sec")), "k", "ts", "id", "hit", "who", forget=3600, late="0 seconds")
    schema = "k string, sec long, id long, hit boolean, who string"
    feed(spark, tmp_path, [("a", 0, 1, True, "x"), ("a", 10, 2, True, "x"), ("b", 5, 3, True, "x")], schema, make)
    feed(spark, tmp_path, [("b", 9000, 4, False, "x")], schema, make)  # the watermark passes an hour after a's last row
    feed(spark, tmp_path, [("c", 9100, 5, False, "x")], schema, make)
    feed(spark, tmp_path, [("a", 9200, 6, True, "x"), ("b", 9201, 7, True, "y"), ("b", 9202, 8, True, "z"), ("b", 9203, 9, True, "w")], schema, make)
    got = {(r.key, r.place): r.burst for r in spark.read.schema("key string, place long, burst string").parquet(f"{tmp_path}/out").collect()}
    assert got == {("b", 9): "three_in_a_row"}  # a's third hit in a row came after it was forgotten


def test_buffer_bounds_places(spark, tmp_path):
    make = lambda s: T.buffer_shuffled(s, "s", "i", 16, seed=3)
    for lo in (0, 100, 101):
        feed(spark, tmp_path, [(0, i) for i in range(lo, {0: 100, 100: 101, 101: 250}[lo])], "s long, i long", make)
    got = spark.read.schema("shard long, id long, place long").parquet(f"{tmp_path}/out").unionByName(T.still_held(spark, f"{tmp_path}/state")).collect()
    assert sorted(r.id for r in got) == list(range(250)) == sorted(r.place for r in got)
    assert max(abs(r.id - r.place) for r in got) <= 16 and sum(r.id != r.place for r in got) > 150


def test_resume_tells_what_changed(spark, tmp_path):
    log, where = str(tmp_path / "log"), str(tmp_path / "state")
    write = lambda n, rows, mode="append": spark.createDataFrame(rows, "k long, seq long, v string").coalesce(1).write.mode(mode).parquet(log)
    read = lambda names: spark.read.schema("k long, seq long, v string").parquet(*([log] if names is None else [f"{log}/{n}" for n in names]))
    go = lambda settings="s": R.resume(spark, log, where, read, lambda d: last_write(d, ["k"], "seq"), settings)
    state = lambda s: {r.k: r.v for r in s.collect()}
    write(0, [(1, 1, "a"), (2, 2, "b")])
    status, s = go()
    assert (status, state(s)) == ("BUILT", {1: "a", 2: "b"}) and go()[0] == "READY"
    write(1, [(1, 3, "c")])
    status, s = go()
    assert (status, state(s)) == ("EXTENDED", {1: "c", 2: "b"})
    assert go("other")[0] == "REBUILT" and go("other")[0] == "READY"
    write(2, [(1, 9, "z")], "overwrite")
    status, s = go("other")
    assert (status, state(s)) == ("REBUILT", {1: "z"})
    segments = R.segment_digests(spark, log)
    assert R.root_digest(segments) == R.root_digest(segments.repartition(3)) != R.root_digest(segments.withColumn("n_bytes", F.col("n_bytes") + 1))


def test_a_batch_run_twice_is_written_once(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i,)], "i int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    failed = []

    def f(b):
        if len(failed) == 1:
            failed.append(1)
            raise RuntimeError("lost")
        failed.append(1)
        return b.withColumn("j", F.col("i") * 2)

    stream = lambda: L.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], "i int").schema)
    with pytest.raises(Exception, match="lost"):
        L.each_batch_once(stream(), f, f"{tmp_path}/out", f"{tmp_path}/state")
    L.each_batch_once(stream(), f, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.j for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4]
