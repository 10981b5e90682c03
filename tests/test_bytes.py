"""Lines byte for byte, against Python's own reading of the files."""

import hashlib
import json

from pyspark.sql import functions as F

from quillon.sources import readers

BOM = b"\xef\xbb\xbf"
FILES = {
    "plain.jsonl": b'{"a": 1}\n{"a": 2}\n',
    "torn.jsonl": b'{"a": 1}\n{"a": 2}',
    "crlf.jsonl": b'{"a": 1}\r\n\r\n{"a": 2}\r\r\n',
    "cr.jsonl": b'{"a": 1,\r"b": "x"}\n\r\n{"a": 2}\r',
    "bom.jsonl": BOM + b'{"a": 1}\n' + BOM + b'{"a": 2}\n',
    "bom-torn.jsonl": BOM + b'{"a": 1}',
    "bom-crlf.jsonl": BOM + b'{"a": 7}\r\n{"a": 8}\r\n',
    "broken.jsonl": b'{"a": 1, "b": "\xff\xfe"}\n\x80\n{"a": 3}\n',
    "blank.jsonl": b"\n \t\n\x0b\n",
}


def entries(raw):
    out = []
    for i, line in enumerate(raw.split(b"\n")[: None if not raw.endswith(b"\n") and raw else -1]):
        if line.strip():
            clean = line.rstrip(b"\r\n")
            out.append((i, clean, hashlib.sha256(clean).hexdigest()))
    return out


def test_raw_lines_and_digests(spark, tmp_path):
    for name, raw in FILES.items():
        (tmp_path / name).write_bytes(raw)
    for limit in ("128m", "16b"):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            rows = readers.with_digest(readers.lines(spark, str(tmp_path)), "raw").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        for name, raw in FILES.items():
            mine = sorted((r.line, bytes(r.raw), r.record_sha256) for r in rows if r.file.endswith("/" + name) and bytes(r.raw).strip())
            assert mine == entries(raw), (name, limit)


def test_entries_parse_without_the_mark(spark, tmp_path):
    for name in ("bom-crlf.jsonl", "crlf.jsonl"):
        (tmp_path / name).write_bytes(FILES[name])
    got = readers.entries(spark, str(tmp_path), "a int").collect()
    assert sorted(r.row.a for r in got) == [1, 2, 7, 8]
    assert all(json.loads(bytes(r.raw).decode("utf-8-sig"))["a"] == r.row.a for r in got)


def test_broken_bytes_are_no_object(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(FILES["broken.jsonl"])
    got = {r.line: r.row for r in readers.parse_strict(readers.lines(spark, str(tmp_path / "x.jsonl")), "a int", fail=False).collect()}
    assert got[0] is None and got[1] is None and got[2].a == 3


def test_csv_fields_are_never_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v,w\n1,,""\n2,x,\n')
    assert [tuple(r) for r in readers.read(spark, str(tmp_path / "a.csv")).orderBy("k").collect()] == [("1", "", ""), ("2", "x", "")]
    d = readers.read(spark, str(tmp_path / "a.csv"), "k long, v string, w string")
    assert d.filter(F.col("v").isNull() | F.col("w").isNull()).count() == 0


def test_rows_of_a_table_as_it_lies(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (5, 1, 17, 40):
        spark.range(n).selectExpr("id * 10 as v", f"{n} as p").coalesce(1).write.mode("append").parquet(path)
    spark.range(0).selectExpr("id as v", "0 as p").coalesce(1).write.mode("append").parquet(path)
    files = {r.file: (r.n, r.first) for r in readers.footer_index(spark, path).collect()}
    assert sorted(n for n, _ in files.values()) == [1, 5, 17, 40]
    total, line = 0, []
    for name in sorted(files):
        assert files[name][1] == total
        total += files[name][0]
        line += [(i * 10, files[name][0]) for i in range(files[name][0])]
    wanted = [0, 4, 5, 6, 22, 23, 62, 63, 99, 5]
    numbers = spark.createDataFrame([(i,) for i in wanted], "index long")
    for few in (1000, 1):
        got = {r["index"]: (r.v, r.p) for r in readers.rows_as_they_lie(spark, path, numbers, few_files=few).collect()}
        assert got == {i: line[i] for i in wanted if i < total}
    assert readers.rows_as_they_lie(spark, path, numbers.limit(0)).count() == 0
