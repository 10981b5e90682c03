"""Streaming forms: stateless maps, packing with carry-over, bursts by key, resumable appends.

State is small and bounded: a packer keeps one open bin, a burst detector the
last twenty rows of a key. Each function takes and returns a streaming DataFrame,
or starts a query with the caller's checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.packing import best_fit


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream (L1)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what there is and stop; a later call goes on where this one ended."""
    q = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def packed(df: DataFrame, shard: str, order: str, length: str, budget: int) -> DataFrame:
    """(shard, pack, member, length): packs of each micro-batch; the last unfilled bin stays in the state and joins the next batch (L3).

    Rows of a batch are packed in order of `order`. What is still open when the stream ends
    is read from the state by `open_packs`.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, ids, sizes = state.get if state.exists else (0, [], [])
        rows = pd.concat(list(frames))[[order, length]].sort_values(order)
        items = list(zip(list(ids) + rows[order].tolist(), list(sizes) + rows[length].tolist(), strict=True))
        bins = best_fit([n for _, n in items], budget)
        last = max(bins, default=-1)
        out = [(key[0], done + b, i, n) for (i, n), b in zip(items, bins, strict=True) if b != last]
        rest = [x for x, b in zip(items, bins, strict=True) if b == last]
        state.update((done + last, [int(i) for i, _ in rest], [int(n) for _, n in rest]))
        if out:
            yield pd.DataFrame(out, columns=["shard", "pack", "member", "length"])

    own = df.select(F.col(shard).cast("long").alias(shard), F.col(order).cast("long").alias(order), F.col(length).cast("long").alias(length))
    return own.groupBy(shard).applyInPandasWithState(
        run, "shard long, pack long, member long, length long", "done long, ids array<long>, sizes array<long>", "append", GroupStateTimeout.NoTimeout
    )


def open_packs(spark: SparkSession, checkpoint: str, shard: str = "shard") -> DataFrame:
    """(shard, pack, member, length): the bins that a stream of `packed` left open, from its state; with its output they hold every row (L3)."""
    state = spark.read.format("statestore").load(checkpoint).select(F.col(f"key.{shard}").alias("shard"), F.col("value.groupState.*"))
    each = state.select("shard", F.col("done").alias("pack"), F.explode(F.arrays_zip("ids", "sizes")).alias("x"))
    return each.select("shard", "pack", F.col("x.ids").alias("member"), F.col("x.sizes").alias("length"))


def bursts(df: DataFrame, key: str, order: str, hit: str, recent: int = 20) -> DataFrame:
    """(key, place, burst): three hits in a row, or five among a key's last `recent` rows; the state is those rows."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        out = []
        for o, h in pd.concat(list(frames))[[order, hit]].sort_values(order).itertuples(index=False):
            last = [*last, bool(h)][-recent:]
            if len(last) >= 3 and all(last[-3:]):
                out.append((k[0], o, "three_in_a_row"))
            elif sum(last) >= 5:
                out.append((k[0], o, "five_in_recent"))
        state.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["key", "place", "burst"])

    own = df.select(F.col(key).cast("string").alias(key), F.col(order).cast("long").alias(order), F.col(hit).cast("boolean").alias(hit))
    return own.groupBy(key).applyInPandasWithState(run, "key string, place long, burst string", "last array<boolean>", "append", GroupStateTimeout.NoTimeout)


def windowed(df: DataFrame, ts: str, key: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by time window and key with a watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n): runs of a key's rows with less than `gap` between neighbours; a run ends a gap after its last row."""
    w = F.session_window(ts, gap)
    return df.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def each_batch(df: DataFrame, f, checkpoint: str) -> None:
    """f(batch, number) for each micro-batch of what there is (L4)."""
    df.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch_once(df: DataFrame, f, sink: str, checkpoint: str) -> None:
    """f(batch) of each micro-batch, written under its number: a batch that is run again after a failure replaces what it wrote (L4)."""

    def write(batch: DataFrame, number: int) -> None:
        f(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    each_batch(df, write, checkpoint)


def head_split(df: DataFrame, order: str, n: int, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(val, train) of the first n rows by an explicit order: int(n * ratio) rows are val (F3, L2). For bounded input."""
    k = int(n * ratio)
    first = df.orderBy(order).limit(n)
    val = first.orderBy(order).limit(k)
    return val, first.join(val.select(order), order, "left_anti")
