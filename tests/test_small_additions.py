"""Compatibility forms, digests of inventories, bounded batches, plug-ins from files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillon import plugins
from quillon.functions import text as T
from quillon.operators import metrics as M
from quillon.operators import reports
from quillon.sources import readers


def test_compatibility_forms(spark):
    d = spark.createDataFrame([("ﬁne ＡＢＣ １２；",), ("x² ; ",), ("plain.",), (None,), ("é",)], "t string")
    assert [r[0] for r in d.select(T.norm_concept(F.col("t"), compose=True)).collect()] == ["fine abc 12", "x2", "plain", None, "é"]
    assert d.select(T.norm_concept(F.col("t"))).first()[0] == "ﬁne ａｂｃ １２；"


def test_inventory_with_digests(spark, tmp_path):
    for name, raw in (("a", b"one"), ("b", b"two"), ("c", b"three"), ("d", b"x")):
        (tmp_path / name).write_bytes(raw)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = spark.createDataFrame([("a", 3, sha(b"one").upper()), ("b", 3, sha(b"owt")), ("c", 4, sha(b"three")), ("e", 1, sha(b""))], "path string, size long, sha256 string")
    got = {r.path: r.state for r in readers.inventory(spark, str(tmp_path), want).collect()}
    assert got == {"a": "ok", "b": "digest", "c": "size", "d": "extra", "e": "missing"}
    assert {r.path: r.state for r in readers.inventory(spark, str(tmp_path), want.drop("sha256")).collect()}["b"] == "ok"


def test_batches_are_bounded(spark):
    d = spark.range(10).select(F.lit(0).alias("b"), "id", F.array(F.lit(1.0)).alias("q"), F.array(F.lit(1.0)).alias("d"))
    assert M.in_batch_scores(d, "b", "id", "q", "d").count() == 100
    with pytest.raises(ValueError, match="10 rows"):
        M.in_batch_scores(d, "b", "id", "q", "d", most=9)


def test_plugins_from_a_file(spark, tmp_path):
    path = tmp_path / "own_plugin_of_a_test.py"
    path.write_text("def double(x):\n    return x * 2\n\n\ndef register(to):\n    to.add('double', double)\n")
    module = plugins.load(spark, str(path))
    kind = reports.Registry("reward")
    module.register(kind)
    twice = F.pandas_udf(kind.get("double")[0], "long")
    assert [r[0] for r in spark.range(4).repartition(2).select(twice("id").alias("x")).orderBy("x").collect()] == [0, 2, 4, 6]
    assert plugins.load(spark, str(path)) is module
    other = tmp_path / "x"
    other.mkdir()
    (other / "own_plugin_of_a_test.py").write_text("")
    with pytest.raises(ImportError):
        plugins.load(spark, str(other / "own_plugin_of_a_test.py"))
    with pytest.raises(FileNotFoundError):
        plugins.load(spark, str(tmp_path / "none.py"))
