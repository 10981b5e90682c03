"""From raw documents to packed training sequences, by five of the training-data operators.

Each stage works on all rows that the stage before it kept; between stages the
rows are written and read again by the caller, or simply passed on by run().

1. language_id: documents whose text is null or has no letters go. Where no
   language could be learnt, those with letters stay.
2. simhash_near_dedup: of each group of near-duplicates one row stays.
3. benchmark_decontamination: documents contaminated by the benchmark go.
4. secret_scan: secrets are replaced by a mark; every document stays.
5. packing: documents become power-of-two sequences.

Rows are told apart by their id and text: where ids repeat with different texts,
or are null, each row is judged by its own text. Repeated rows are copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, language, packing, secrets, simhash
from quillon.llm.queries import tokenizer_path
from quillon.llm.shared import cut, small_side

#: Removed rows are broadcast up to this number (16 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 100_000


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs less the rows named in bad (doc_id, key), key being the text's hash; null ids are matched too."""
    gone = cut(bad.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct())
    match = F.col("d.doc_id").eqNullSafe(F.col("g._id")) & (F.xxhash64("d.text") == F.col("g._key"))
    return docs.alias("d").join(small_side(gone, BROADCAST_IDS).alias("g"), match, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose text has letters, whatever language the model tells."""
    model = language.fit_on_training_folds(docs)
    found = language.predict(docs.withColumn("_key", F.xxhash64("text")), model, keep=("_key",), with_letters=True)
    return _without(docs, found.filter(~F.col("has_letters")).withColumnRenamed("_key", "key"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: the smallest id (a null one last), among rows that share it the smallest text hash."""
    groups = cut(simhash.near_duplicates(docs).select("group", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key").alias("row")))
    kept = cut(groups.groupBy("group").agg(F.min("row").alias("row")).select("row.doc_id", "row.key"))
    own = docs.alias("d").join(kept.alias("k"), F.expr("d.doc_id <=> k.doc_id and xxhash64(d.text) = k.key"), "left_semi")
    rows, texts = groups.select("row.doc_id", "row.key").alias("d").join(kept.alias("k"), F.expr("d.doc_id <=> k.doc_id and d.key = k.key"), "left_semi").agg(F.count("*"), F.lit(kept.count())).first()
    if rows == texts:
        return own
    return own.withColumn("_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_key"]).drop("_key")  # some kept rows are repeated


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the text; n_chars follows."""
    found = secrets.scan(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "text"))
    changed = {"text": F.col("redacted"), "n_chars": F.when(F.size("secrets") > 0, F.length("redacted").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[changed[c].alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of all that is left."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]
#: The language classifier has no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
