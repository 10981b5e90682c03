"""Helpers that several operators use: checkpoints, components, bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import components, merged_components, spread_join  # noqa: F401
from ..session import cut  # noqa: F401


#: Rows of an Arrow batch at most: texts are long, and both sides of the socket hold a batch.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session set to Arrow batches of BATCH_ROWS rows at most; a smaller setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def small_side(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; beyond that, Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
