"""State kept beside an append-only log, checked against the log's digests before it is used.

A log is a folder of segments (files that, once written, stay as they are). Each
segment's bytes are digested in a task; the digests form a tree: segments by the first
digits of their name's hash, these by one root. State is saved with the root, the
segments it was made from, and a digest of the settings. On resumption the saved root
is compared first; where it differs, the segments: if all saved ones are unchanged and
new ones came, the state is extended by these alone, else it is rebuilt from the log.

A version of the state counts once its line stands in the folder's index, which is
written last; so a lost driver leaves the version before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "version long, root string, settings string, status string"


def segment_digests(spark: SparkSession, log: str) -> DataFrame:
    """(segment, n_bytes, sha256) of a log's files; each is read by one task, so segments should be rolled at a bounded size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(log)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("segment"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def root_digest(segments: DataFrame) -> str:
    """One digest of all segments: of 4,096 digests of those whose names' hashes begin alike, so no list grows with the log alone."""
    own = segments.select(F.substring(F.sha2("segment", 256), 1, 3).alias("b"), F.concat_ws(":", "segment", F.col("n_bytes").cast("string"), "sha256").alias("x"))
    each = own.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("d"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "d"))), "\n"), 256)).first()[0]


def _last(spark: SparkSession, where: str) -> tuple[int, str, str] | None:
    from ..sources.sinks import _fs

    fs, path = _fs(spark, f"{where}/index")
    if not fs.exists(path):
        return None
    row = spark.read.schema(INDEX).parquet(f"{where}/index").orderBy(F.desc("version")).first()
    return None if row is None else (row["version"], row["root"], row["settings"])


def resume(spark: SparkSession, log: str, where: str, read: Callable[[list[str] | None], DataFrame], fold: Callable[[DataFrame], DataFrame], settings: str = "") -> tuple[str, DataFrame]:
    """(status, state) of a log: BUILT, READY (nothing changed), EXTENDED (segments were added) or REBUILT (a segment or the settings changed).

    read gives the log's rows of the named segments, or of all if None; fold reduces rows to the state, and must give the same from
    a state and new rows as from all rows. `where` holds the state's versions.
    """
    digest = hashlib.sha256(settings.encode()).hexdigest()
    segments = segment_digests(spark, log)
    root, last = root_digest(segments), _last(spark, where)
    if last and last[1:] == (root, digest):
        return "READY", spark.read.parquet(f"{where}/state-{last[0]}")
    status, state = "BUILT" if last is None else "REBUILT", None
    if last and last[2] == digest:
        known = spark.read.parquet(f"{where}/segments-{last[0]}")
        if known.join(segments, ["segment", "n_bytes", "sha256"], "left_anti").limit(1).count() == 0:
            fresh = [r[0] for r in segments.join(known, "segment", "left_anti").select("segment").collect()]  # names of new files
            before = spark.read.parquet(f"{where}/state-{last[0]}")
            status, state = "EXTENDED", fold(before.unionByName(read(fresh)))
    if state is None:
        state = fold(read(None))
    version = (last[0] if last else 0) + 1
    state.write.mode("overwrite").parquet(f"{where}/state-{version}")
    segments.write.mode("overwrite").parquet(f"{where}/segments-{version}")
    spark.createDataFrame([(version, root, digest, status)], INDEX).coalesce(1).write.mode("append").parquet(f"{where}/index")
    return status, spark.read.parquet(f"{where}/state-{version}")
