"""Queries of file sources and sinks: tables are written under the shared scratch folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as J
from ..sources import readers as R
from ..sources import sinks as S
from ..sources import spec
from .common import checkpoint_folder, table


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: suppliers written as JSON Lines, CSV, Parquet, ORC and text, read by extension, and counted alike."""
    where = _scratch(spark)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat("s_name", F.lit(' "a, b"\nc'))).alias("name"))
    ddl = "s_suppkey long, name string"
    s.write.json(f"{where}/a.jsonl")
    s.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{where}/a.csv")
    s.write.parquet(f"{where}/a.parquet")
    s.write.orc(f"{where}/a.orc")
    s.select(F.concat_ws("|", "s_suppkey", F.replace("name", F.lit("\n"), F.lit("/")))).write.text(f"{where}/a.txt")
    frames = [R.read(spark, f"{where}/a.{e}", None if e in ("parquet", "orc") else ddl).select(F.lit(e).alias("format"), "s_suppkey", "name") for e in ("jsonl", "csv", "parquet", "orc")]
    text = R.read(spark, f"{where}/a.txt").select(F.lit("txt").alias("format"), F.split_part("value", F.lit("|"), F.lit(1)).cast("long").alias("s_suppkey"), F.replace(F.split_part("value", F.lit("|"), F.lit(2)), F.lit("/"), F.lit("\n")).alias("name"))
    return R.union_ragged([*frames, text])


def file_byte_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: documents as JSON lines with line feeds as lone carriage returns, a third of them ending with CR LF; digests of the raw lines read back."""
    where = _scratch(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    flat = F.translate("text", '\n"\\\t', "\r||")
    line = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "x": "'), F.regexp_replace(flat, r"[\x00-\x0C\x0E-\x1F]", ""), F.lit('"}'), F.when(F.col("doc_id") % 3 == 0, "\r").otherwise(""))
    d.select(line.alias("value")).write.option("lineSep", "\n").text(f"{where}/docs.jsonl")
    # a carriage return within a string is no JSON, so only the number is read from the text
    read = R.with_digest(R.lines(spark, f"{where}/docs.jsonl"), "raw")
    return read.select(F.regexp_extract("value", r"^\{.doc_id.: (-?\d+)", 1).cast("long").alias("doc_id"), F.octet_length("raw").cast("long").alias("n_bytes"), "record_sha256")


def file_rows_as_they_lie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row of the suppliers and customers, by their places in the tables as they lie."""
    out = []
    for name, key in (("supplier", "s_suppkey"), ("customer", "c_custkey")):
        path = f"{sf_dir}/{name}.parquet"
        n = spark.read.parquet(path).count()
        rows = R.rows_as_they_lie(spark, path, spark.range(3, n + 100, 7).select(F.col("id").alias("index")))
        out.append(rows.select(F.lit(name).alias("name"), "index", F.col(key).cast("long").alias("key")))
    return R.union_ragged(out)


_SPECS = ("AI/sql#500", "hf::a/b:x/y#20", "MS::name", "odd::c:d", "plain", "a/b:all")


def source_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: nations' keys choose a source string; its parts and the subsets it stands for."""
    known = spec.Dataset("x", subsets=(spec.Subset("default"), spec.Subset("x"), spec.Subset("weak", weak=True)))
    rows = []
    for i, text in enumerate(_SPECS):
        p = spec.SourceSpec.parse(text)
        rows.append((i, p.name, p.hub, p.rows, ",".join(s.name for s in spec.choose_subsets(known, p.subsets))))
    parts = spark.createDataFrame(rows, "i int, name string, hub string, rows int, subsets string")
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % len(_SPECS)).cast("int").alias("i"))
    return n.join(F.broadcast(parts), "i").drop("i")


def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets registered from JSON, found by full name, last component and snapshot folder."""
    c = spec.Catalog()
    c.register_json('[{"name": "org/alpha", "tags": ["chat"]}, {"name": "org/beta", "subsets": ["a", {"name": "b", "weak": true}]}, {"name": "other/beta"}]')
    asked = ["org/alpha", "alpha", "x/alpha", "beta", "org/beta", "/cache/models--org--alpha/snapshots/0a1b", "none"]
    found = [(i, a, getattr(c.find(a), "name", None)) for i, a in enumerate(asked)]
    f = spark.createDataFrame(found, "i int, asked string, found string")
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % len(asked)).cast("int").alias("i"))
    return n.join(F.broadcast(f), "i").drop("i")


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written files against a list that misses one, has one too many and one of a wrong size; row counts agree."""
    where = _scratch(spark)
    r = table(spark, sf_dir, "region")
    out = []
    for k in range(5):
        S.append(r.filter(F.col("r_regionkey") == k).coalesce(1), f"{where}/t")
    files = spark.read.format("binaryFile").load(f"{where}/t").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.col("length").alias("size"), F.row_number().over(_by_path()).alias("i"))
    listed = files.filter("i <> 1").select("path", (F.col("size") + F.when(F.col("i") == 2, 1).otherwise(0)).alias("size")).unionByName(spark.createDataFrame([("gone.parquet", 9)], "path string, size long"))
    state = R.inventory(spark, f"{where}/t", listed)
    out = state.groupBy("state").agg(F.count("*").alias("n"))
    same = R.counts_agree(spark.read.parquet(f"{where}/t"), r)
    return out.withColumn("same_rows", F.lit(same))


def _by_path():
    from pyspark.sql import Window as W

    return W.partitionBy(F.lit(0)).orderBy("path")  # a listing of five files


def file_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of archive members that would leave their folder, made from the pages' addresses."""
    p = table(spark, sf_dir, "pages")
    name = F.element_at(F.array(F.col("url"), F.concat(F.lit("../"), "url"), F.concat(F.lit("/"), "url"), F.concat(F.lit("a\\..\\"), "url"), F.lit("C:x")), (F.col("page_id") % 5 + 1).cast("int"))
    return p.select("page_id", R.safe_member(name).alias("safe"))


def file_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release is built once, found again, and not overwritten by another content."""
    where = _scratch(spark)
    n = table(spark, sf_dir, "nation")
    steps = [S.release(n, f"{where}/r"), S.release(n.orderBy(F.desc("n_name")), f"{where}/r")]
    try:
        S.release(n.filter("n_nationkey > 3"), f"{where}/r")
    except FileExistsError:
        steps.append("REFUSED")
    steps.append(S.release(n.filter("n_nationkey > 3"), f"{where}/r", overwrite=True))
    return spark.read.parquet(f"{where}/r").select("n_nationkey", "n_name").withColumn("steps", F.lit(",".join(steps)))


def file_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends make one table."""
    where = _scratch(spark)
    n = table(spark, sf_dir, "nation")
    S.append(n.filter("n_nationkey < 10"), f"{where}/a")
    S.append(n.filter("n_nationkey >= 7"), f"{where}/a")
    return spark.read.parquet(f"{where}/a").select("n_nationkey", "n_name")


def file_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of encoded rows, read up to a length."""
    where = _scratch(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.array("n_chars", F.floor(F.col("n_chars") / 2)).alias("lengths"))
    S.write_cache(d, f"{where}/c")
    return S.read_cache(spark, f"{where}/c", 1500).select("doc_id")


def file_rows_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered by key and read back by number."""
    where = _scratch(spark)
    R.write_indexed(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", f"{where}/i", rows_per_part=400)
    return R.rows_at(spark, f"{where}/i", [0, 3, 399, 400, 401, 1203, 10**9], rows_per_part=400).select("index", "o_orderkey", "o_totalprice")


def doc_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and languages that two halves share, and that the first has alone."""
    d = table(spark, sf_dir, "documents")
    a, b, on = d.filter("doc_id % 7 < 3"), d.filter("doc_id % 7 >= 3 and n_chars > 900"), ["source", "lang"]
    return J.intersection(a, b, on).withColumn("kind", F.lit("both")).unionByName(J.difference(a, b, on).withColumn("kind", F.lit("first")))


def doc_with_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two sources with labelled ones of another, whose ids are others."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    old = d.filter("source = 'src5'").join(table(spark, sf_dir, "labels"), "doc_id")
    return J.with_replay(d.filter("source in ('src1', 'src2')"), old, ["doc_id", "source"])


def doc_deletion_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter only deletes; a changed row is foreign."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    kept = d.filter("lang is not null and doc_id % 3 > 0")
    changed = kept.withColumn("lang", F.when(F.col("doc_id") % 10 == 1, "xx").otherwise(F.col("lang")))
    return J.deletion_proof(d, kept).unionByName(J.deletion_proof(d, changed))


_SPEC = ", ".join(f"({i}, '{n}', {h}, {r}, '{s}')" for i, (n, h, r, s) in enumerate((("AI/sql", "null", "500", "default"), ("a/b", "'hf'", "20", "x,y"), ("name", "'ms'", "null", "default"), ("c", "null", "null", "d"), ("plain", "null", "null", "default"), ("a/b", "null", "null", "default,x"))))
_ASKED = "(0, 'org/alpha', 'org/alpha'), (1, 'alpha', 'org/alpha'), (2, 'x/alpha', 'org/alpha'), (3, 'beta', null), (4, 'org/beta', 'org/beta'), (5, '/cache/models--org--alpha/snapshots/0a1b', 'org/alpha'), (6, 'none', null)"
QUERIES = {
    "file_byte_lines": (file_byte_lines, r"""with l as (select doc_id, '{"doc_id": ' || doc_id || ', "x": "' || regexp_replace(translate(coalesce(text, ''), chr(10) || '"\' || chr(9), chr(13) || '||'), '[\x00-\x0C\x0E-\x1F]', '', 'g') || '"}' x from documents)
        select doc_id, strlen(x)::bigint n_bytes, sha256(x) record_sha256 from l"""),
    "file_rows_as_they_lie": (file_rows_as_they_lie, """with s as (select row_number() over () - 1 as "index", s_suppkey k from supplier), c as (select row_number() over () - 1 as "index", c_custkey k from customer)
        select 'supplier' as name, "index", k::bigint as key from s where "index" % 7 = 3 union all select 'customer', "index", k::bigint from c where "index" % 7 = 3"""),
    "file_formats": (file_formats, """select f as format, s_suppkey, case when s_suppkey % 3 = 0 then '' else s_name || ' "a, b"' || chr(10) || 'c' end as name from supplier, unnest(['jsonl', 'csv', 'parquet', 'orc', 'txt']) x(f)"""),
    "source_specs": (source_specs, f"select n_nationkey, name, hub, rows, subsets from nation join (values {_SPEC}) v(i, name, hub, rows, subsets) on n_nationkey % 6 = i"),
    "source_catalog": (source_catalog, f"select n_nationkey, asked, found from nation join (values {_ASKED}) v(i, asked, found) on n_nationkey % 7 = i"),
    "file_inventory": (file_inventory, "select * from (values ('ok', 3::bigint, true), ('size', 1, true), ('missing', 1, true), ('extra', 1, true)) v(state, n, same_rows)"),
    "file_archives": (file_archives, "select page_id, page_id % 5 = 0 safe from pages"),
    "file_release": (file_release, "select n_nationkey, n_name, 'BUILT,ALREADY_BUILT,REFUSED,BUILT' steps from nation where n_nationkey > 3"),
    "file_append": (file_append, "select n_nationkey, n_name from nation where n_nationkey < 10 union all select n_nationkey, n_name from nation where n_nationkey >= 7"),
    "file_cache": (file_cache, "select doc_id from documents where n_chars <= 1500"),
    "file_rows_at": (file_rows_at, """select i as "index", o_orderkey, o_totalprice from (select *, row_number() over (order by o_orderkey) - 1 i from orders) where i in (0, 3, 399, 400, 401, 1203)"""),
    "doc_intersection": (doc_intersection, """with a as (select distinct source, lang from documents where doc_id % 7 < 3), b as (select distinct source, lang from documents where doc_id % 7 >= 3 and n_chars > 900)
        select *, 'both' kind from (select * from a intersect select * from b) union all select *, 'first' from (select * from a except select * from b)"""),
    "doc_with_replay": (doc_with_replay, "select doc_id, source, 'current' origin, null::int quality, null::int toxic from documents where source in ('src1', 'src2') union all select doc_id, source, 'replay', quality, toxic from documents join labels using (doc_id) where source = 'src5'"),
    "doc_deletion_proof": (doc_deletion_proof, """with d as (select doc_id, lang from documents), k as (select * from d where lang is not null and doc_id % 3 > 0), s as (select (select count(*) from d) n, (select count(*) from k) m, (select count(*) from k where doc_id % 10 = 1) f)
        select n n_before, m n_after, n - m n_removed, 0::bigint n_foreign, true holds from s union all select n, m, n - m, f, f = 0 from s"""),
}
