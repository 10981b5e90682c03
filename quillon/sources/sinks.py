"""Sinks: staged releases, appends, encoded caches, rows by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def content_digest(df: DataFrame) -> str:
    """A digest of the rows whatever their order."""
    h = F.sum(F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns]).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), h.alias("h")).first()
    return f"{r['n']}-{r['h']}"


def release(df: DataFrame, path: str, *, overwrite: bool = False) -> str:
    """Write to a staging folder, then rename; a release with the same content is `ALREADY_BUILT`, another one refuses to be overwritten."""
    spark, digest = df.sparkSession, content_digest(df)
    fs, target = _fs(spark, path)
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, f"_digest-{digest}")
    if fs.exists(target):
        if fs.exists(marker):
            return "ALREADY_BUILT"
        if not overwrite:
            raise FileExistsError(path)
    staging = f"{path.rstrip('/')}._staging-{digest}"
    df.write.mode("overwrite").parquet(staging)
    _, stage = _fs(spark, staging)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(staging, f"_digest-{digest}")).close()
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(stage, target):
        raise OSError(f"{staging} could not be renamed to {path}")
    return "BUILT"


def append(df: DataFrame, path: str) -> None:
    """Append rows; Spark's commit makes them appear together."""
    df.write.mode("append").parquet(path)


def write_cache(df: DataFrame, path: str, lengths: str = "lengths") -> None:
    """Rows with their lengths, for later reads that filter by them."""
    if lengths not in df.columns:
        raise ValueError(f"{lengths} is missing")
    df.write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str, most: int | None = None, lengths: str = "lengths") -> DataFrame:
    """Cached rows, those whose greatest length is over `most` left out."""
    df = spark.read.parquet(path)
    return df if most is None else df.filter(F.array_max(lengths) <= most)


def manifest(df: DataFrame, name: str) -> DataFrame:
    """A one-row summary: rows, columns and content digest."""
    return df.sparkSession.createDataFrame([(name, df.count(), ",".join(sorted(df.columns)), content_digest(df))], "name string, n long, columns string, digest string")
