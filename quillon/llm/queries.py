"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    from .decontaminate import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word passages of all documents that start in a document with a smaller id are removed."""
    from .substring import remove_repeats

    kept = remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules with compression bands over all documents."""
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each speaker's side."""
    from .chat import rotate

    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["from"].cast("string"), x["to"].cast("string"))), ",")
    return rotate(_table(spark, sf_dir, "conversations")).withColumn("mask", spans).drop("spans")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: places, and a digest of the text without them."""
    from .secrets import scan

    found = scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.array_join(F.transform("secrets", lambda x: F.concat_ws("+", x["char_start"].cast("string"), x["n_chars"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), places.alias("places"), F.sha2("redacted", 256).alias("redacted_sha256"))


#: The key of the registered query; a user of the operator gives their own.
PSEUDONYM_KEY = b"quillon example key"


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with confirmed numbers, dates and addresses under pseudonyms."""
    from .pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents."""
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error-correcting output codes over all documents, learnt from the training folds."""
    from .language import identify

    return identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pigeonring search over the fingerprints of all documents."""
    from .simhash import as_hex, near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 5-word shingles overlap at 0.8 or more."""
    from .jaccard import join

    return join(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors; every seventh has the next label."""
    from .mining import mine

    v = _table(spark, sf_dir, "embeddings")
    label = F.when(v["vec_id"] % 7 == 0, (v["label"].cast("long") + 1) % 10).otherwise(v["label"])
    return mine(v, anchors=v["vec_id"] % 100 == 0, label=label)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language over all documents."""
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_decontamination, op2_substring_dedup, op3_quality_rules, op4_chat_rotation, op5_secret_scan, op6_packing,
            op7_license_scan, op8_pii_pseudonyms, op9_language_id, op10_simhash,
            op11_jaccard_join, op12_hard_negatives, op13_source_divergence,
        )
    }


def oracle_sql() -> dict[str, str]:
    from . import chat, decontaminate, divergence, jaccard, mining, secrets, substring

    return {"op1_decontamination": decontaminate.SQL.format(docs="documents"), "op2_substring_dedup": substring.SQL, "op4_chat_rotation": chat.SQL, "op5_secret_scan": secrets.sql(secrets.train()),
            "op11_jaccard_join": jaccard.SQL.format(docs="documents"), "op12_hard_negatives": mining.SQL.format(vectors="embeddings"), "op13_source_divergence": divergence.SQL.format(docs="documents")}
