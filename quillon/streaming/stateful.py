"""Stateful stream operators with list state and timers: the full limiter, and shuffling through a bounded buffer.

A key's rows of one micro-batch are sorted before they meet the state, so a micro-batch
should hold rows in time order among batches; its size is the source's to bound
(maxFilesPerTrigger and the like). Between batches the state holds at most the stated
number of rows a key. The session needs the RocksDB state store (`with_rocksdb`).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_rocksdb(spark: SparkSession) -> None:
    """Set the session's state store to RocksDB, which keeps list state and timers on disk beside the executor, with changes in the checkpoint."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Rows of a key whose results leave a task at once.
PIECE = 10_000


def compact(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """us, place and hit of all rows, the number of each row's ident, and the distinct idents: 21 bytes a row, whatever the idents' length."""
    numbers: dict = {}
    parts: list[tuple[np.ndarray, ...]] = []
    for f in frames:
        if f[["us", "place"]].isna().any(axis=None):
            raise ValueError("a call needs a time and a place")
        codes, found = pd.factorize(f["ident"], use_na_sentinel=False)
        own = np.array([numbers.setdefault(None if pd.isna(x) else x, len(numbers)) for x in found], dtype=np.int32)
        parts.append((f["us"].to_numpy(np.int64), f["place"].to_numpy(np.int64), f["hit"].to_numpy(bool), own[codes]))
    us, place, hit, ident = (np.concatenate(x) for x in zip(*parts, strict=True))
    return us, place, hit, ident, list(numbers)


class Limiter(StatefulProcessor):
    """Three refusals in a row, else five among the last `recent` calls, else three ids refused within `minutes` (L6). A key idle for `forget` seconds of event time is forgotten by a timer."""

    def __init__(self, key: str, recent: int, minutes: int, forget: int):
        self.key, self.recent, self.span, self.forget = key, recent, minutes * 60_000_000, forget * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "us long, hit boolean, ident string")
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = [tuple(x) for x in self.calls.get()] if self.calls.exists() else []
        us, place, hit, ident, names = compact(rows)
        order = np.lexsort((place, us))
        for at in range(0, len(order), PIECE):  # results leave in pieces, so only the numbers of a batch's rows are held
            out = []
            for i in order[at : at + PIECE].tolist():
                last = [*last, (int(us[i]), bool(hit[i]), names[ident[i]])][-self.recent :]
                reason = self.reason(last, last[-1][0])
                if reason:
                    out.append((str(key[0]), int(place[i]), reason))
            if out:
                yield pd.DataFrame(out, columns=["key", "place", "burst"])
        self.calls.put(last)
        self.remind(last[-1][0] // 1000 + self.forget)

    def reason(self, last: list[tuple[int, bool, str]], now: int) -> str | None:
        hits = [x for x in last if x[1]]
        if len(last) >= 3 and all(x[1] for x in last[-3:]):
            return "three_in_a_row"
        if len(hits) >= 5:
            return "five_in_recent"
        return "several_ids" if len({i for us, _, i in hits if us >= now - self.span}) >= 3 else None

    def remind(self, at: int) -> None:
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        self.handle.registerTimer(at)
        self.until.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.calls.clear()
        self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def limiter(df: DataFrame, key: str, ts: str, place: str, hit: str, ident: str, *, recent: int = 20, minutes: int = 5, forget: int = 7 * 86_400, late: str = "10 minutes") -> DataFrame:
    """(key, place, burst) of a stream of calls: all three rules of `attempts.bursts`, with the rows that a key needs kept between micro-batches."""
    with_rocksdb(df.sparkSession)
    t = F.col(ts).cast("timestamp")
    own = df.select(F.col(key).cast("string").alias("key"), t.alias("at"), F.unix_micros(t).alias("us"), F.col(place).cast("long").alias("place"), F.col(hit).cast("boolean").alias("hit"), F.col(ident).cast("string").alias("ident"))
    timed = own.withWatermark("at", late).groupBy("key")
    return timed.transformWithStateInPandas(Limiter(key, recent, minutes, forget), "key string, place long, burst string", "Append", "EventTime")


class Exchange(StatefulProcessor):
    """A bounded exchange buffer: see `buffer_shuffled`."""

    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "due double, id long, arrived long")
        self.seen = handle.getValueState("seen", "arrived long, sent long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived, sent = self.seen.get() if self.seen.exists() else (0, 0)
        buffer = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        heapq.heapify(buffer)
        out = []
        for i in pd.concat(list(rows))["id"].sort_values().tolist():
            heapq.heappush(buffer, (arrived + self.size * share(self.seed, i), int(i), arrived))
            arrived += 1
            while buffer and buffer[0][0] < arrived:  # rows to come are due at `arrived` or later
                _, one, _ = heapq.heappop(buffer)
                out.append((int(key[0]), one, sent))
                sent += 1
        if buffer:
            self.held.put(buffer)
        else:
            self.held.clear()
        self.seen.update((arrived, sent))
        if out:
            yield pd.DataFrame(out, columns=["shard", "id", "place"])

    def close(self) -> None:
        pass


def share(seed: int, ident: int) -> float:
    """A number from 0 to 1 of a row, the same everywhere."""
    return int(hashlib.sha256(f"{seed}|exchange|{ident}".encode()).hexdigest()[:12], 16) / 16**12


def buffer_shuffled(df: DataFrame, shard: str, ident: str, size: int, seed: int = 42) -> DataFrame:
    """(shard, id, place): rows of a shard in an order shuffled through a buffer of at most `size` rows.

    Row i of a shard (arrivals in order of ident within a micro-batch) is due at i + size * u, u from 0 to 1 by its hash, and
    rows leave in order of that: each once, and no row leaves more than `size` places from where it came. The rows still held when
    the stream ends are read from the state by `still_held`.
    """
    with_rocksdb(df.sparkSession)
    own = df.select(F.col(shard).cast("long").alias("shard"), F.col(ident).cast("long").alias("id"))
    return own.groupBy("shard").transformWithStateInPandas(Exchange(size, seed), "shard long, id long, place long", "Append", "None")


def still_held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(shard, id, place): what a stream of `buffer_shuffled` held when it ended, with the places that follow; with its output, every row once."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    held = read("held").select(F.col("key.shard").alias("shard"), "list_element.*")
    sent = read("seen").select(F.col("key.shard").alias("shard"), F.col("value.sent").alias("sent"))
    place = F.row_number().over(W.partitionBy("shard").orderBy("due", "id")) - 1  # a buffer's rows at most
    return held.join(sent, "shard").select("shard", "id", (place + F.col("sent")).cast("long").alias("place"))
