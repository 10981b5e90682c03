"""Small helpers of the plans: tables and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, cut  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int = 10_000) -> DataFrame:
    """df in as many parts as its rows need at `rows` each, for work that is dear a row: a few MB of a file can hold a million short rows, which Spark would give to one task."""
    return df.repartition(-(-df.count() // rows) or 1, key)


def halves(text: str) -> tuple[Column, Column]:
    """The first and the second half of a text's characters."""
    n = F.floor(F.length(text) / 2).cast("int")
    return F.substring(text, 1, n), F.substring(text, n + 1, F.length(text))


#: The halves in SQL.
HALVES_SQL = ("substring(text, 1, length(text) // 2)", "substring(text, length(text) // 2 + 1)")
