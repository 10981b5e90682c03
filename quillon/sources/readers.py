"""Readers: by extension, JSON Lines strict or with a torn tail, lines with digests, ragged unions, file inventories."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

FORMATS = {"jsonl": "json", "json": "json", "csv": "csv", "txt": "text", "parquet": "parquet", "orc": "orc"}


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The format follows the extension; an empty CSV field is an empty string, quoted or not, never a null (A1)."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in FORMATS:
        raise ValueError(f"no reader for .{ext}")
    r = spark.read.format(FORMATS[ext])
    if ext == "csv":
        r = r.option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "\u0000")
    df = (r.schema(schema) if schema is not None else r).load(path)
    return df.na.fill("") if ext == "csv" else df  # string columns only: Spark reads an unquoted empty field as a null


def read_splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All splits as one table; columns that one of them lacks are null."""
    return union_ragged([read(spark, p) for p in paths])


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Cut from the ends of a line to see whether it is blank.
BLANK = " \t\n\r\x0b\x0c"
BOM = "\ufeff"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw, value) of text files, byte for byte (A8-A10): lines end at byte 0x0A alone and are numbered from 0 in each file.

    raw: the line's bytes without the CR and LF at its end, a byte order mark and broken UTF-8 left as they are. value: the same
    as text without the mark. Files are read in splits; lines are numbered within their split and the counts of the file's
    earlier splits added, so a very large file is no single task. The reader cuts a mark at the file's start; that there
    was one shows in the file's size, which is then larger than its lines. A file that holds a mark alone has no line.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.col("_metadata.file_size").alias("_s"), F.monotonically_increasing_id().alias("_m"), "value")
    counts = raw.groupBy("file", "_b").agg(F.count("*").alias("_n"), F.sum(F.octet_length("value") + F.lit(1)).alias("_bytes"), F.max("_s").alias("_s"))
    own = W.partitionBy("file")
    before = own.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("file", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), (F.col("_s") - F.sum("_bytes").over(own) >= 2).alias("_marked"))
    numbered = raw.drop("_s").withColumn("_r", F.row_number().over(W.partitionBy("file", "_b").orderBy("_m")) - 1).join(offsets, ["file", "_b"])
    line, clean = (F.col("_r") + F.col("_o")).cast("long"), F.rtrim("value", F.lit("\r\n"))
    return numbered.select("file", line.alias("line"), F.when((line == 0) & F.col("_marked"), F.concat(F.lit(BOM), clean)).otherwise(clean).cast("binary").alias("raw"), clean.alias("value"))


def _full(rows: DataFrame) -> DataFrame:
    return rows.filter(F.btrim("value", F.lit(BLANK)) != "")


def _is_object(value: str) -> Column:
    return F.coalesce(F.is_valid_utf8(value) & F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


def parse_strict(rows: DataFrame, schema: T.StructType | str, fail: bool = True) -> DataFrame:
    """(file, line, value, row): JSON objects only; blank lines are skipped; any other line fails with its place, or is kept with a null row."""
    full, ok = _full(rows), _is_object("value")
    row = F.from_json("value", schema)
    bad = F.concat(F.lit("not a JSON object: "), F.col("file"), F.lit(":"), (F.col("line") + 1).cast("string"))
    return full.withColumn("row", F.when(ok, row).otherwise(F.raise_error(bad).cast(row_type(schema)) if fail else F.lit(None)))


def row_type(schema: T.StructType | str) -> T.DataType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def parse_torn(rows: DataFrame, schema: T.StructType | str) -> DataFrame:
    """As parse_strict, but a broken last line of a file is dropped, as an interrupted writer leaves it."""
    full = _full(rows)
    last = full.groupBy("file").agg(F.max("line").alias("_last"))
    marked = full.join(last, "file").withColumn("_ok", _is_object("value")).filter(F.col("_ok") | (F.col("line") != F.col("_last")))
    bad = F.concat(F.lit("broken line: "), F.col("file"), F.lit(":"), (F.col("line") + 1).cast("string"))
    return marked.withColumn("row", F.when(F.col("_ok"), F.from_json("value", schema)).otherwise(F.raise_error(bad).cast(row_type(schema)))).drop("_ok", "_last")


def with_digest(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with the digest of the untouched line (A10): of `raw` for the bytes as they stand in the file."""
    return rows.withColumn("record_sha256", F.sha2(value, 256))


def entries(spark: SparkSession, path: str, schema: T.StructType | str, fail: bool = True) -> DataFrame:
    """(file, line, raw, record_sha256, row): the JSON objects of files with the digests of their raw lines; blank lines are skipped (A10)."""
    return with_digest(parse_strict(lines(spark, path), schema, fail), "raw").select("file", "line", "raw", "record_sha256", "row")


def counts_agree(a: DataFrame, b: DataFrame) -> bool:
    """Whether two copies have the same number of rows."""
    return a.count() == b.count()


def inventory(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(path, size, expected, state): files against expected (path, size); `missing`, `extra`, `size` or `ok`.

    If expected has a column sha256, files' bytes are digested in tasks too, and `digest` tells one of the right size with other bytes.
    """
    own = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("_sha"))
    if "sha256" in expected.columns:
        both = own.join(expected.select("path", F.col("size").alias("expected"), "sha256"), "path", "full_outer")
        other = F.when(F.col("_sha") != F.lower("sha256"), "digest")
        state = F.when(F.col("size").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("size") != F.col("expected"), "size")
        return both.withColumn("state", F.coalesce(state, other, F.lit("ok"))).drop("_sha", "sha256")
    found = own.drop("_sha")
    both = found.join(expected.select("path", F.col("size").alias("expected")), "path", "full_outer")
    state = F.when(F.col("size").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("size") != F.col("expected"), "size").otherwise("ok")
    return both.withColumn("state", state)


def number_rows(df: DataFrame, order: str, name: str = "index") -> DataFrame:
    """df with an index from 0 by a unique order, worked out in ranges of about equally many rows."""
    from ..operators.sampling import number_rank

    return number_rank(df, order, name).withColumn(name, F.col(name) - 1)


def write_indexed(df: DataFrame, order: str, path: str, name: str = "index", rows_per_part: int = 1_000_000) -> None:
    """Rows with their number, sorted by it in a folder a range, so that reads by number touch few files."""
    own = number_rows(df, order, name).withColumn("part", F.floor(F.col(name) / rows_per_part))
    own.repartition("part").sortWithinPartitions(name).write.mode("overwrite").partitionBy("part").parquet(path)


def rows_at(spark: SparkSession, path: str, numbers: list[int], name: str = "index", rows_per_part: int = 1_000_000) -> DataFrame:
    """The rows of these numbers: their ranges' folders alone are listed, and row groups without them skipped."""
    parts = sorted({n // rows_per_part for n in numbers})
    return spark.read.parquet(path).filter(F.col("part").isin(parts) & F.col(name).isin(numbers)).drop("part")


def footer_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, first): rows of each Parquet file and the index (from 0) of its first row, files in order of their names.

    No column is read: the counts are those of the footers, read in tasks. A file without rows is left out.
    """
    from ..operators.scans import running

    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    return running(counts, [], ["file"], {"_upto": F.col("n")}).select("file", "n", (F.col("_upto") - F.col("n")).alias("first"))


def locate(index: DataFrame, numbers: DataFrame, name: str = "index") -> DataFrame:
    """(name, file, row): in which file, at which place, the row of each number stands; numbers beyond the table are left out.

    The line of all rows is cut into as many cells as there are files; files and numbers meet by cell, so about three rows a file
    are compared with those of the numbers that lie near.
    """
    total, files = index.agg(F.sum("n"), F.count("*")).first()
    width = max(1, -(-(total or 0) // max(files, 1)))
    cells = index.withColumn("_c", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("n") - 1) / width))))
    own = numbers.select(F.col(name).cast("long").alias(name)).withColumn("_c", F.floor(F.col(name) / width))
    inside = (F.col(name) >= F.col("first")) & (F.col(name) < F.col("first") + F.col("n"))
    return own.join(cells, "_c").filter(inside).select(name, "file", (F.col(name) - F.col("first")).alias("row"))


def rows_as_they_lie(spark: SparkSession, path: str, numbers: DataFrame, name: str = "index", few_files: int = 1000) -> DataFrame:
    """The rows of the given numbers of a Parquet table as it lies, with their number; nothing is rewritten.

    Up to `few_files` files are opened alone; beyond that the table is scanned and meets the places by a join.
    """
    places = cut(locate(footer_index(spark, path), numbers.distinct(), name))
    files = [r["file"] for r in places.select("file").distinct().limit(few_files + 1).collect()]  # names of at most few_files + 1 files
    whole = spark.read.parquet(path)
    if not files:
        return whole.limit(0).select("*", F.lit(0).cast("long").alias(name))
    alone = files[0].rsplit("/", 1)[-1] == path.rstrip("/").rsplit("/", 1)[-1]  # the table is one file
    table = whole if alone or len(files) > few_files else spark.read.schema(whole.schema).option("basePath", path).parquet(*files)
    placed = table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    match = (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r"))
    return placed.join(places.select(F.col("file").alias("_f"), F.col("row").alias("_r"), name), match).drop("_file", "_row", "_f", "_r")


def member_is_safe(name: str) -> bool:
    """Whether an archive member stays inside the folder it is unpacked to."""
    parts = name.replace("\\", "/").split("/")
    return not (name.startswith(("/", "\\")) or ".." in parts or (len(name) > 1 and name[1] == ":"))


def safe_member(name: Column) -> Column:
    """The same on a column of names."""
    return ~(name.rlike(r"^[/\\]") | name.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)") | name.rlike("^.:"))


def archive_faults(spark: SparkSession, path: str) -> DataFrame:
    """(path, fault) of zip archives: unreadable ones, members with a wrong checksum, members that would leave the folder."""
    import io
    import zipfile

    import pandas as pd

    def check(frames):
        for f in frames:
            out = []
            for p, content in zip(f["path"], f["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        bad = z.testzip()
                        out += [(p, f"checksum: {bad}")] if bad else []
                        out += [(p, f"leaves the folder: {n}") for n in z.namelist() if not member_is_safe(n)]
                except zipfile.BadZipFile:
                    out.append((p, "unreadable"))
            yield pd.DataFrame(out, columns=["path", "fault"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(check, "path string, fault string")
